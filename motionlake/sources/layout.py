"""What a header row says about a file.  Works on names only; no data is read here."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..functions import rules


def detect_layout(headers: Sequence[str]) -> str | None:
    """``long`` or ``wide``, or None where the header leaves it open; never a matter of how many rows there are."""
    if len(set(headers) & rules.LONG_HEADERS) >= 3:
        return "long"
    return "wide" if header_is_wide(headers) else None


def header_is_wide(headers: Sequence[str]) -> bool:
    names = set(headers)
    bracketed = [name for name in headers if "[" in name and "]" in name]
    return (
        len(bracketed) > 5
        or "Name" in names
        or len(names & rules.WIDE_ID_HEADERS) >= 3
        or len(names & rules.WIDE_METRIC_HEADERS) >= 3
    )


def standard_headers(headers: Sequence[str]) -> dict[str, list[str]]:
    """Target header -> its source headers, in file order of first appearance.

    Sources of one target are listed in the order of the vendor table, which is the order they are coalesced in.
    """
    order = list(rules.VENDOR_HEADERS)
    targets: dict[str, list[str]] = {}
    for name in headers:
        targets.setdefault(rules.VENDOR_HEADERS.get(name, name), []).append(name)
    for sources in targets.values():
        sources.sort(key=lambda s: order.index(s) if s in order else len(order))
    return targets


def looks_like_metric(header: str) -> bool:
    if any(symbol in header for symbol in rules.METRIC_SYMBOLS):
        return True
    lowered = header.lower()
    return any(word in lowered for word in rules.METRIC_KEYWORDS)


def split_header(header: str) -> tuple[str, str]:
    """``Name [unit]`` split at the last bracket pair; without a valid pair the name stays and the unit is empty."""
    name, _, tail = header.rpartition("[")
    unit, closing, _ = tail.rpartition("]")
    return (name.rstrip(), unit) if name and closing else (header, "")


@dataclass(frozen=True)
class WideColumns:
    ids: list[str]
    metrics: list[str]
    dropped: list[str]


def split_columns(headers: Sequence[str]) -> WideColumns:
    """Identifier, metric and unused columns of a wide file with standard headers."""
    ids = [h for h in headers if h in rules.ID_HEADERS]
    rest = [h for h in headers if h not in rules.ID_HEADERS]
    metrics = [h for h in rest if looks_like_metric(h)]
    return WideColumns(ids, metrics, [h for h in rest if h not in metrics])


def missing_columns(headers: Sequence[str]) -> list[str]:
    return sorted(rules.REQUIRED_LONG - set(headers))
