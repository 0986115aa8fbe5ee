"""Files of one folder that do not share a header.

A CSV scan takes one header for all its files.  Here each file's header is read on its own (its first line only), files
are grouped by header, and each group is one scan; what a caller makes of the groups can then be joined by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Headers that are read at a time.
AT_ONCE = 16


def literal_path(uri: str) -> str:
    """A listed file's address as a path to read: decoded, its own wildcard characters escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def header_groups(spark: SparkSession, path: str | Sequence[str], read: Callable[[list[str]], DataFrame]) -> list[DataFrame]:
    """One table per different header under ``path`` (a file, folder, wildcard or list of these), in the order of file names.

    ``read`` reads files of one header.  Files without a header (empty ones) are left out.  Driver work is one line per
    file, ``AT_ONCE`` at a time; no data passes through the driver.
    """
    names = sorted(literal_path(f) for f in spark.read.text(path if isinstance(path, str) else list(path)).inputFiles())
    if not names:
        return []

    def header(name: str) -> tuple[str, ...]:
        return tuple(read([name]).columns)

    with ThreadPool(min(AT_ONCE, len(names))) as pool:
        headers = pool.map(inheritable_thread_target(spark)(header), names)
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, columns in zip(names, headers, strict=True):
        if columns:
            groups.setdefault(columns, []).append(name)
    return [read(files) for files in groups.values()]


def united(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that some tables lack is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
