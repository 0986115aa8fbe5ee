"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed rules and always stay.  Added kinds are ``iban`` (mod-97) and ``ssn``
(range rules and context); they are kept from ``THRESHOLD`` on and where they touch no base span.  All of it is a function
of one text, so rows never meet: no shuffle, and memory is one text's spans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import appended, appending, field, fresh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.6
#: Context is looked for in so many characters before a span and after it.
NEAR = 40

# Words near a span that speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write to", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
}
# Trust in a proposed and confirmed span without context.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT_GAIN = 0.3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind and the possessive run skip starts inside a run of digits, where no other match can begin
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
# runs of fewer than 13 digits would be dropped anyway
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_WORD_OF_IBAN = re.compile("[A-Z0-9]+")
#: Characters of an account number by country (the published registry).
IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}
LEAST_IBAN = 15
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NO_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    """Each match has one @, so only the characters around each @ are looked at."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, (end := m.end())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start."""
    spans = [("email", *x) for x in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _iban_ends(proposed: str) -> list[int]:
    """Where an account number may end: at its country's length, or else with the whole; of other countries at any word end."""
    ends = [m.end() for m in _WORD_OF_IBAN.finditer(proposed)]
    length = IBAN_LENGTH.get(proposed[:2])
    fitting = [e for e in ends if len(proposed[:e].replace(" ", "")) == length]
    return [*fitting, len(proposed)] if length else [e for e in reversed(ends) if len(proposed[:e].replace(" ", "")) >= LEAST_IBAN]


def _added(text: str) -> list[tuple[str, int, int]]:
    spans = []
    at = 0
    while m := _IBAN.search(text, at):
        # what follows may look like more of it, and what looks like a beginning may stand before it
        end = next((e for e in _iban_ends(m[0]) if mod97(m[0][:e].replace(" ", ""))), None)
        if end is not None:
            spans.append(("iban", m.start(), m.start() + end))
        at = m.start() + (end or 1)
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            spans.append(("ssn", *m.span()))
    return spans


def score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    near = any(re.search(rf"(?<!\w){re.escape(w)}", around) for w in CONTEXT[kind])
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * near)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans ``(kind, start, end, score)`` by kind as in ``KINDS``, then start; null text has none."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, score(text, *s)) for s in base]
    for kind, start, end in _added(text):
        worth = score(text, kind, start, end)
        if worth >= THRESHOLD and all(end <= a or b <= start for _, a, b in base):
            found.append((kind, start, end, worth))
    return found


SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()),
])


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, found`` (spans in code points, end exclusive).

    Null and empty text have no span; ids may be null or repeated; other columns are not read.
    """
    rows = docs.select(field(docs, id, "doc_id"), field(docs, text, "text"))
    adds = StructType([StructField("found", ArrayType(SPAN))])
    return rows.mapInArrow(appending(_work, ["text"], adds), appended(rows, adds)).drop("text")


def _work(text: str | None) -> tuple:
    return ([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(text)],)


def redacted(text: str | None) -> tuple[str | None]:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return (text,)
    parts, at = [], 0
    for kind, start, end, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return ("".join(parts) + text[at:],)


def redact(docs: DataFrame, text: str = "text", into: str | None = None) -> DataFrame:
    """``docs`` with personal data masked in the text (or in a new column ``into``)."""
    into = text if into is None else fresh(docs, into)[0]
    adds = StructType([StructField(into, StringType())])
    out = docs.mapInArrow(appending(redacted, [text], adds), appended(docs, adds))
    return out.select([f"`{c}`" for c in [*docs.columns, *([] if into in docs.columns else [into])]])
