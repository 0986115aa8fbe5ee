"""Quality rules: statistics of a text, and line frequency across the documents of a host.

Lines are normalised and hashed; for each host (the source column) and line the distinct documents holding it are counted.  A
line in more than ``MIN_DOCS`` of them, whatever the size of the host, is taken out of every document but the first that has
it: the smallest id among those that pass the base rules.  A document that loses more than half of its words is depleted and
rejected.  ``clean`` looks for the first among documents that are kept, so that a passage stays once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from motionlake.session import settle

from .common import WORD, appended, appending, ascii_lower, compact, counted, field, fresh, settled, utf8

#: Fixed by the contract: the symbols, the least words, the most words in repeated windows (per cent).
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A line is boilerplate of its host in more distinct documents.
MIN_DOCS = 20
#: Rounds that propose lines to the smallest id.
IN_ORDER = 3

_DIGIT = re.compile("[0-9]")


def normal_line(words: list[str]) -> str:
    """One space between words, A-Z in lower case, every digit 0."""
    return _DIGIT.sub("0", ascii_lower(" ".join(words)))


def line_hash(words: list[str]) -> int:
    value = xxhash.xxh3_64_intdigest(utf8(normal_line(words)))
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows found twice or more, the first occurrence included."""
    n = len(words)
    first: dict[str, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if n < 4 or len(first) == n:
        return 0
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:  # n**3 would not fit
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift : n - 2 + shift] |= twice
    return int(hit.sum())


def text_statistics(text: str | None) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, then the distinct lines' hashes and their words."""
    words: list[str] = []
    seen: set[str] = set()
    lines: dict[int, int] = {}
    duplicates = 0
    for line in (text or "").split("\n"):
        own = WORD.findall(line)
        if own:
            duplicates += line in seen
            seen.add(line)
            key = line_hash(own)
            lines[key] = lines.get(key, 0) + len(own)
            words += own
    symbols = sum(map((text or "").count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, duplicates, repeated_words(words), list(lines), list(lines.values())


_STATISTICS = StructType(
    [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField(n, ArrayType(LongType())) for n in ("lines", "line_words")]
)


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def _holders(held: DataFrame) -> DataFrame:
    """``key, first``: the document that keeps each line, of ``doc, key, words, n_words`` (documents without base failures).

    In each round every open line is proposed to a document that would not be depleted if it kept all its open lines; lines
    whose proposed document survives are settled.  The first ``IN_ORDER`` rounds propose the smallest id.  Later ones go by a
    hash of the document and the round, so documents that share lines do not wait for each other in a row: a fixed part of
    them gets all it asks for, and rounds grow with the logarithm of the lines.  The document that comes first gets
    all its open lines, so each round settles some.  A line is left out if every document that has it loses more than half
    of its words to lines settled elsewhere.
    """
    doc_id = F.col("doc.doc_id")
    own = F.col("known").isNotNull() & doc_id.eqNullSafe(F.col("first"))

    def turn(id: Column, round: int) -> Column:
        if round < IN_ORDER:
            return F.min(id)
        return F.min_by(id, F.when(id.isNotNull(), F.struct(F.xxhash64(id, F.lit(round)), id)))

    def surviving(known: DataFrame, lost: Column, lines: Column) -> DataFrame:
        """The ``lines`` of documents that are left with half of their words, each with its document."""
        named = known.select(F.col("key").alias("_key"), "first", F.lit(True).alias("known"))
        marked = held.join(named, held["key"].eqNullSafe(F.col("_key")), "left")
        by_doc = marked.groupBy("doc").agg(
            F.sum(F.when(lost, F.col("words")).otherwise(0)).alias("lost"), F.first("n_words").alias("n_words"), F.collect_list(F.when(lines, F.col("key"))).alias("lines")
        )
        return by_doc.where((F.col("n_words") - F.col("lost")) * 2 >= F.col("n_words")).select(F.explode("lines").alias("key"), doc_id.alias("first"))

    proposed, seen = counted(held.groupBy("key").agg(turn(doc_id, 0).alias("first")))
    proposed = compact(proposed, seen["n"])
    done, n, lines, round = proposed.limit(0), 0, seen["n"], 0
    while True:
        done, seen = counted(surviving(done.union(proposed), ~own, own).distinct())
        done = compact(done, seen["n"])
        before, n, round = n, seen["n"], round + 1
        if n in (before, lines):
            return done
        open_lines = surviving(done, F.col("known").isNotNull() & ~own, F.col("known").isNull())
        proposed = settled(open_lines.groupBy("key").agg(turn(F.col("first"), round).alias("first")))


def verdicts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, represent: bool = False
) -> DataFrame:
    """One row per document row: ``doc_id, source, text_hash``, the statistics, ``n_removed`` (words in lines taken out),
    ``removed`` (hashes of those lines or null), ``base_failed`` and ``kept``.

    Null text has no words and fails.  The null host is a host.  Rows equal in id, host and text get equal verdicts.  Null ids
    are not counted, and where the documents that pass the base rules have no other id, those without id keep the line.  With
    ``represent``, a line's first document is one that is kept.
    """
    rows = docs.select(
        field(docs, id, "doc_id"), field(docs, host, "source"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), field(docs, text, "text")
    )
    base = settle(rows.mapInArrow(appending(text_statistics, ["text"], _STATISTICS), appended(rows, _STATISTICS)).drop("text"))
    once = base.select("doc_id", "source", "text_hash", "n_words", _failed().alias("failed"), F.explode(F.arrays_zip("lines", "line_words")).alias("_l"))
    once = once.select("doc_id", "source", "text_hash", "n_words", "failed", F.col("_l.lines").alias("line"), F.col("_l.line_words").alias("words"))
    first = F.min(F.when(~F.col("failed"), F.col("doc_id")))
    limited = once.groupBy("source", "line").agg(F.countDistinct("doc_id").alias("_n"), first.alias("_first")).where(F.col("_n") > min_docs)
    limited = limited.select(F.col("source").alias("_source"), F.col("line").alias("_line"), "_first")
    once = once.dropDuplicates(["doc_id", "source", "text_hash", "line"])
    held = once.join(limited, (once["line"] == limited["_line"]) & once["source"].eqNullSafe(limited["_source"]))
    stays = F.col("doc_id").eqNullSafe(F.col("_first"))
    if represent:
        key = F.struct("source", "line").alias("key")
        held = settled(held.drop("_source", "_line", "_first").where(~F.col("failed")))
        first = _holders(held.select(F.struct("doc_id", "source", "text_hash").alias("doc"), key, "words", "n_words"))
        first = first.select(F.col("key").alias("_key"), F.col("first").alias("_first"))
        held = held.join(first, F.struct("source", "line").eqNullSafe(F.col("_key")), "left")
        stays = F.col("_key").isNotNull() & stays
    lost = (
        held.where(~stays)
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.sum("words").alias("n_removed"), F.collect_list("line").alias("removed"))
        .withColumnsRenamed({"doc_id": "_d", "source": "_s", "text_hash": "_t"})
    )
    same = base["doc_id"].eqNullSafe(lost["_d"]) & base["source"].eqNullSafe(lost["_s"]) & base["text_hash"].eqNullSafe(lost["_t"])
    return (
        base.join(lost, same, "left")
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
        .withColumn("base_failed", _failed())
        .withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("n_removed")) * 2 >= F.col("n_words")))
        .drop("_d", "_s", "_t", "lines", "line_words")
    )


def clean(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", length: str = "n_chars", **limits) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; boilerplate lines are taken out of the text of all but one of them.

    Where the text changes, the column ``length`` (if there is one) becomes the new number of characters.
    """
    removed, judged = fresh(docs, "_removed", "_judged")
    # settled before the filter: else Spark prunes the joins below by Bloom filters of each key, which its driver puts into every task's closure
    found = settle(verdicts(docs, id, text, host, represent=True, **limits).select("doc_id", "source", "text_hash", "removed", "kept"))
    found = found.where("kept").dropDuplicates(["doc_id", "source", "text_hash"]).select(F.struct("doc_id", "source", "text_hash").alias(judged), F.col("removed").alias(removed))
    key = F.struct(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{host}`").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    kept = docs.join(found, key.eqNullSafe(F.col(judged))).drop(judged)
    adds = StructType([StructField(text, StringType())])
    cut = kept.mapInArrow(appending(without_lines, [text, removed], adds), appended(kept, adds))
    if length in docs.columns:
        n = F.when(F.col(removed).isNotNull(), F.length(f"`{text}`")).otherwise(F.col(f"`{length}`"))
        cut = cut.withColumn(length, n.cast(docs.schema[length].dataType))
    return cut.select([f"`{c}`" for c in docs.columns])


def without_lines(text: str | None, removed: list[int] | None) -> tuple[str | None]:
    if not text or not removed:
        return (text,)
    gone = set(removed)
    return ("\n".join(_left(text, gone)),)


def _left(text: str, gone: set[int]) -> Iterator[str]:
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words or line_hash(words) not in gone:
            yield line
