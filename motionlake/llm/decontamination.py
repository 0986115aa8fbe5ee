"""Benchmark decontamination by Wu-Manber search over words.

The benchmark's windows (13 consecutive words, or a whole shorter item) are the patterns.  A table of shifts by block of
two words tells how far the search may move on, windows are kept in buckets by their last block and looked up by their
first, and a direct comparison of all words confirms an occurrence.  Documents are searched where they lie: no shuffle.
The benchmark is a stated set; it is broadcast in blocks of at most ``BLOCK_WORDS`` words, one search each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from motionlake.session import settle

from .common import appended, appending, ascii_lower, by_text, field, fresh

#: Words after lower-casing A-Z.
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
BLOCK_WORDS = 200_000
#: Longer items are searched as overlapping pieces of so many words.
PIECE = 4096
#: Contaminated: at least one word in so many is hit.
ONE_IN = 20


def item_words(text: str | None) -> list[str]:
    return ITEM_WORD.findall(ascii_lower(text)) if text else []


class Searcher:
    """Patterns of one length in words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shifts: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}

    def add(self, words: list[str], start: int, item: str) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = tuple(words[start + end - b : start + end])
            self.shifts[key] = min(self.shifts.get(key, m), m - end)
        last, first = tuple(words[start + m - b : start + m]), tuple(words[start : start + b])
        self.buckets.setdefault(last, {}).setdefault(first, []).append((words, start, item))

    def find(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """Start and item of every occurrence."""
        m, b, n = self.length, self.block, len(words)
        shift, buckets, longest = self.shifts.get, self.buckets, self.length - self.block + 1
        end = m
        while end <= n:
            last = (words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],)
            step = shift(last, longest)
            if step:
                end += step
                continue
            start = end - m
            for other, at, item in buckets[last].get(tuple(words[start : start + b]), ()):
                if other[at : at + m] == words[start:end]:
                    yield start, item
            end += 1


def build(pieces: list[tuple[str, list[str]]], window: int = WINDOW) -> list[Searcher]:
    searchers: dict[int, Searcher] = {}
    for item, words in pieces:
        m = min(window, len(words))
        if m:
            searcher = searchers.setdefault(m, Searcher(m))
            for start in range(len(words) - m + 1):
                searcher.add(words, start, item)
    return list(searchers.values())


def _pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    def work(text: str | None, item: str | None) -> Iterator[tuple]:
        words = item_words(text)
        for start in range(0, max(1, len(words) - window + 1), PIECE):
            part = words[start : start + PIECE + window - 1]
            if part:
                yield item or "", " ".join(part), len(part)

    out = StructType([StructField("item", StringType()), StructField("words", StringType()), StructField("n", LongType())])
    rows = benchmark.select(field(benchmark, text, "text"), benchmark[f"`{item}`"].cast("string").alias("item"))
    return rows.mapInArrow(by_text(work, out), out)


def search(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """The rows of ``docs`` with three columns more, called ``names``.

    ``n_words``; ``spans``: word ranges (start, end, start, end, ...) that are hit, merged and in order; ``items``: the ids,
    as text, of items with an occurring window, sorted.  Null or wordless text has no words and no hit; a null item id
    reads as empty text and repeated ids are one item.  An empty benchmark hits nothing.
    """
    pieces = settle(_pieces(benchmark, item, item_text, window))
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_words))
    adds = StructType([
        StructField(names[0], LongType()), StructField(names[1], ArrayType(IntegerType())), StructField(names[2], ArrayType(StringType())),
    ])
    nothing = F.array()
    found = docs.select(
        *[f"`{c}`" for c in docs.columns if c not in names], F.lit(0).cast("long").alias(names[0]),
        nothing.cast("array<int>").alias(names[1]), nothing.cast("array<string>").alias(names[2]),
    )
    context = docs.sparkSession.sparkContext
    for block in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        sent = context.broadcast([(r["item"], r["words"]) for r in mine.select("item", "words").collect()])
        found = found.mapInArrow(_searching(sent, window, [text, *names[1:]], adds), appended(found, adds))
        if block < blocks - 1:  # so that a task holds one block at a time
            found = settle(found)
    return found


def _searching(sent, window: int, takes: list[str], adds: StructType):
    def run(batches):
        searchers = build([(item, words.split(" ")) for item, words in sent.value], window)

        def work(text, spans, items) -> tuple:
            words = item_words(text)
            ranges = [(spans[i], spans[i + 1]) for i in range(0, len(spans), 2)]
            named = set(items)
            for searcher in searchers:
                for start, item in searcher.find(words):
                    named.add(item)
                    ranges.append((start, start + searcher.length))
            return len(words), merged(ranges), sorted(named)

        yield from appending(work, takes, adds)(batches)

    return run


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Ranges joined where they touch, flat and in order."""
    flat: list[int] = []
    for start, end in sorted(ranges):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def _n_hit(spans: str):
    lengths = F.transform(f"`{spans}`", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every document row; see ``search``."""
    rows = docs.select(field(docs, id, "doc_id"), field(docs, text, "text"))
    found = search(rows, benchmark, **options).withColumn("n_hit", _n_hit("spans"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        _contaminated("n_hit", "n_words").alias("contaminated"),
    )


def _contaminated(n_hit: str, n_words: str):
    return (F.col(n_hit) > 0) & (F.col(n_hit) * ONE_IN >= F.col(n_words))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    n_words, spans, items, n_hit = fresh(docs, "_n_words", "_spans", "_items", "_n_hit")
    found = search(docs, benchmark, text=text, names=(n_words, spans, items), **options)
    kept = found.withColumn(n_hit, _n_hit(spans)).where(~_contaminated(f"`{n_hit}`", f"`{n_words}`"))
    return kept.select([f"`{c}`" for c in docs.columns])
