"""Repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words; its minimiser is the smallest hash of ``M`` consecutive words in it.  Neighbouring
windows with one minimiser form a run.  Equal windows have equal minimisers, so only runs whose minimiser two documents
share can hold a repeat.  Equal runs are one string; where a bucket (all runs of a minimiser) holds different strings, each
is cut into windows where its text lies; dealt by digest and sorted, they show the smallest document of each window.

Hot passages cost little: their runs are equal strings, folded to the smallest id in each task before any shuffle.  No task
holds a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from motionlake.session import settle

from .common import WORD, WordHashes, appended, appending, by_text, field
from .decontamination import merged
from .neardup import _mixed, _ODD

WINDOW = 50
M = 8
#: Windows that a task holds before it hands them on.
HELD = 10_000


def window_minima(own: np.ndarray, window: int, m: int) -> np.ndarray:
    """Minimiser of every window of a text, from its words' hashes."""
    mers = np.zeros(len(own) - m + 1, np.uint64)
    for i in range(m):
        mers = _mixed(mers * _ODD + own[i : len(mers) + i])
    wide, span = window - m + 1, 1
    while span * 2 <= wide:
        mers = np.minimum(mers[:-span], mers[span:])
        span *= 2
    rest = wide - span
    return np.minimum(mers[: len(mers) - rest], mers[rest:]) if rest else mers


def runs(words: list[str], hashes: WordHashes, window: int = WINDOW, m: int = M) -> Iterator[tuple[int, int, int, bytes]]:
    """Minimiser, first window, number of windows and fingerprint of every run of a text."""
    if len(words) < window:
        return
    own = hashes.array(words)
    least = window_minima(own, window, m)
    starts = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
    raw, least = memoryview(own.tobytes()), least.view(np.int64)
    for start, end in zip(starts, starts[1:], strict=False):
        yield int(least[start]), start, end - start, xxhash.xxh3_128_digest(raw[start * 8 : (end + window - 1) * 8])


def _runs(rows: DataFrame, window: int, m: int) -> DataFrame:
    out = StructType([
        StructField("id", rows.schema["id"].dataType), StructField("mini", LongType()), StructField("start", IntegerType()),
        StructField("n", IntegerType()), StructField("key", BinaryType()),
    ])

    def run(batches):
        hashes = WordHashes()

        def work(text: str, id) -> Iterator[tuple]:
            for found in runs(WORD.findall(text), hashes, window, m):
                yield id, *found

        yield from by_text(work, out)(batches)

    return rows.mapInArrow(run, out)


def _windows(texts: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """``key, at, digest, first``: windows of each different string of a bucket, cut from the smallest document that holds it."""
    wanted = keys.groupBy("first").agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted"))
    held = texts.join(wanted, texts["id"] == wanted["first"]).select("text", "id", "wanted")
    out = StructType([
        StructField("key", BinaryType()), StructField("at", IntegerType()), StructField("digest", BinaryType()), StructField("first", texts.schema["id"].dataType),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark.sql.pandas.types as arrow_types

        hashes, schema, rows = WordHashes(), arrow_types.to_arrow_schema(out), []

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for at in range(batch.num_rows):
                text, id, wanted = (c[at].as_py() for c in batch.columns)
                words = WORD.findall(text)
                for w in wanted:
                    raw = memoryview(hashes.array(words[w["start"] : w["start"] + w["n"] + window - 1]).tobytes())
                    # rows may share an id and differ in text
                    if xxhash.xxh3_128_digest(raw) == w["key"]:
                        for i in range(w["n"]):
                            rows.append((w["key"], i, xxhash.xxh3_128_digest(raw[i * 8 : (i + window) * 8]), id))
                            if len(rows) == HELD:
                                yield full()
        if rows:
            yield full()

    return held.mapInArrow(run, out)


def _lower(windows: DataFrame) -> DataFrame:
    """``key, lower``: places of the windows that a smaller document holds in another string.

    Windows are dealt by digest and stream through in order; a task remembers one digest and its smallest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = np.empty((0, 2), np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, at, digest, first = batch.columns
            before = len(last)
            own = np.concatenate([last, np.frombuffer(b"".join(digest.to_pylist()), np.uint64).reshape(-1, 2)])
            firsts = first if least is None else pa.concat_arrays([least, first])
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]).any(1)
            smallest = firsts.take(pa.array(np.flatnonzero(new)[np.cumsum(new) - 1]))
            lower = pc.not_equal(firsts, smallest).slice(before)
            last, least = own[-1:], smallest.slice(len(own) - 1)
            yield pa.RecordBatch.from_arrays([key.filter(lower), at.filter(lower)], names=["key", "at"])

    dealt = windows.repartition("digest").sortWithinPartitions("digest", "first")
    return dealt.mapInArrow(run, "key binary, at int").groupBy("key").agg(F.collect_set("at").alias("lower"))


def _covered(window: int, out: StructType):
    def work(lower, id, start, n, first) -> Iterator[tuple]:
        if first < id:
            yield id, [start, start + n + window - 1]
        else:
            yield id, merged([(start + i, start + i + window) for i in sorted(lower)])

    return by_text(work, out, "lower")


def repeated(rows: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """``id, spans`` of the documents with words to remove; ``rows`` (``id, text``) without nulls.

    Spans are word ranges (start, end, start, end, ...), not yet merged over a document's runs.
    """
    found = _runs(rows, window, m)
    shared = found.groupBy("mini").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("mini")
    held = settle(found.join(shared, "mini"))
    # of the smallest document any place will do
    keys = held.groupBy("mini", "key", "n").agg(F.min("id").alias("first"))
    several = keys.groupBy("mini").agg(F.count("*").alias("strings")).where("strings > 1").select("mini")
    places = held.select(F.col("mini").alias("m"), F.col("key").alias("k"), F.col("id").alias("first"), "start")
    mixed = keys.join(several, "mini").join(places, (F.col("mini") == F.col("m")) & (F.col("key") == F.col("k")) & (keys["first"] == places["first"]))
    mixed = mixed.groupBy("mini", "key", "n", keys["first"]).agg(F.min("start").alias("start"))
    joined = held.join(keys.drop("n"), ["mini", "key"]).join(_lower(_windows(rows, mixed, window)), "key", "left")
    open_runs = joined.where((F.col("lower").isNotNull()) | (F.col("first") < F.col("id")))
    out = StructType([StructField("id", rows.schema["id"].dataType), StructField("spans", ArrayType(IntegerType()))])
    spans = open_runs.select("lower", "id", "start", "n", "first").mapInArrow(_covered(window, out), out)
    return spans.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keep_words(text: str | None, spans: list[int] | None) -> tuple[list[str], int]:
    """The words outside the spans, and the number of all words."""
    words = WORD.findall(text) if text else []
    flat = merged(list(zip(spans[::2], spans[1::2], strict=True))) if spans else []
    ends = [0, *flat, len(words)]
    kept = [w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]]
    return kept, len(words)


def _with_spans(docs: DataFrame, id: str, text: str, window: int, m: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(field(docs, id, "id"), field(docs, text, "text"))
    named = rows.where("id is not null and text is not null")
    found = repeated(named, window, m).withColumnRenamed("id", "_id")
    rest = rows.where("id is null or text is null").withColumn("spans", F.lit(None).cast("array<int>"))
    return named.join(found, F.col("id") == F.col("_id"), "left").drop("_id"), rest


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, m: int = M) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_removed, text`` (the kept words joined by one space).

    Every word is removed that lies in a window whose words also start in a document with a smaller id.  Null text has no
    words and stays null; texts shorter than a window stay.  A row without id is compared with nothing; rows with equal ids
    don't count as each other's repeats, and each loses what any of them would lose at its places.
    """
    return _result(docs, id, text, window, m, StructField("text", StringType()), _kept_text)


def repeat_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, m: int = M) -> DataFrame:
    """As ``remove_repeats``, with ``kept_sha256`` of the kept text instead of the text."""
    return _result(docs, id, text, window, m, StructField("kept_sha256", StringType()), _kept_digest)


def _kept_text(text: str | None, spans: list[int] | None) -> tuple:
    kept, n = keep_words(text, spans)
    return n, n - len(kept), None if text is None else " ".join(kept)


def _kept_digest(text: str | None, spans: list[int] | None) -> tuple:
    kept, n = keep_words(text, spans)
    return n, n - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()


def _result(docs: DataFrame, id: str, text: str, window: int, m: int, last: StructField, work) -> DataFrame:
    adds = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), last])
    parts = [p.mapInArrow(appending(work, ["text", "spans"], adds), appended(p, adds)) for p in _with_spans(docs, id, text, window, m)]
    names = ["id", "n_words", "n_removed", last.name]
    return parts[0].select(names).union(parts[1].select(names)).withColumnRenamed("id", "doc_id")
