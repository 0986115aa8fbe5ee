"""Language identification: words first, character n-grams for unseen words.

A word known to the model scores by its log frequency in each language; an unknown word is cut into character n-grams,
longest first, and the first length with a known n-gram decides.  Texts are scored where they lie.

Training reads a bounded hash sample of labelled rows (``train_rows``); counts are summed in Spark.  An entry (word or
n-gram of a language) is kept if its share of the language's count is at least ``languages / entries``, so the model has at
most ``entries`` entries of each length whatever the input, and may be broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import SLICE, appended, appending, field

TRAIN_ROWS = 20_000
ENTRIES = 200_000
LONGEST = 4
#: log10 of the frequency taken for what a language has not shown.
PENALTY = -7.0
#: Words from which on more of them make a score no surer.
SURE = 20
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return [w for w in LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def held_out(id: Column) -> Column:
    """A quarter of the documents, by checksum of the id as text (null: empty text)."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count(batches):
    """Words (length 0) and n-grams of each language, summed over a slice of texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE * 8):
            part = batch.slice(start, SLICE * 8).to_pydict()
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(part["lang"], part["text"], strict=True):
                words[lang].update(letter_words(text))
            rows = []
            for lang, counts in words.items():
                by_length = [counts, *(Counter() for _ in range(LONGEST))]
                for word, count in counts.items():
                    for n in range(1, LONGEST + 1):
                        for gram in grams(word, n):
                            by_length[n][gram] += count
                rows += [(lang, n, g, c) for n, own in enumerate(by_length) for g, c in own.items()]
            if rows:
                lang, n, gram, count = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(count, pa.int64())],
                    names=["lang", "n", "gram", "count"],
                )


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = TRAIN_ROWS, entries: int = ENTRIES) -> dict:
    """The model of the labelled rows (null labels are left out): languages, most frequent first, and gains over
    ``PENALTY`` by length and entry.  No labelled word at all gives a model without languages."""
    rows = labelled.where(labelled[f"`{lang}`"].isNotNull())
    n = rows.count()
    hashed = F.pmod(F.xxhash64(F.lit("train"), F.col(f"`{key}`").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.where(hashed < train_rows / max(n, 1)).select(rows[f"`{lang}`"].cast("string").alias("lang"), field(rows, text, "text"))
    counts = rows.mapInArrow(_count, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    counts = counts.persist()
    try:
        totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
        words = {r["lang"]: r["total"] for r in totals.where("n = 0").collect()}
        langs = sorted(words, key=lambda x: (-words[x], x))
        enough = counts.join(totals, ["lang", "n"]).where(F.col("count") * entries >= F.col("total") * len(langs))
        found = enough.select("lang", "n", "gram", F.log10(F.col("count") / F.col("total")).alias("log")).toArrow().to_pydict()
    finally:
        counts.unpersist()
    kept: dict[int, dict[str, list]] = {n: {} for n in range(LONGEST + 1)}
    at = {name: i for i, name in enumerate(langs)}
    for name, length, gram, log in sorted(zip(*found.values(), strict=True)):
        kept[length].setdefault(gram, []).append((at[name], log - PENALTY))
    return {"langs": langs, "kept": kept}


class Scorer:
    """Scores texts with a model; remembers a bounded number of unknown words."""

    LIMIT = 200_000

    def __init__(self, model: dict):
        self.langs, self.words = model["langs"], model["kept"][0]
        self.grams = [model["kept"][n] for n in range(LONGEST + 1)]
        self.unseen: dict[str, list] = {}

    def unknown(self, word: str) -> list:
        if len(self.unseen) >= self.LIMIT:
            self.unseen.clear()
        gains: dict[int, float] = {}
        for n in range(LONGEST, 0, -1):
            known = [own for g in grams(word, n) if (own := self.grams[n].get(g))]
            if known:
                for own in known:
                    for lang, gain in own:
                        gains[lang] = gains.get(lang, 0.0) + gain / len(known)
                break
        found = self.unseen[word] = list(gains.items())
        return found

    def gains(self, text: str | None) -> tuple[int, list[float]]:
        """Number of words and the mean gain of each language."""
        counts = Counter(letter_words(text))
        total, sums = sum(counts.values()), [0.0] * len(self.langs)
        for word, count in counts.items():
            own = self.words.get(word) or self.unseen.get(word)
            for lang, gain in self.unknown(word) if own is None else own:
                sums[lang] += count * gain
        return total, [s / total for s in sums] if total else sums

    def __call__(self, text: str | None) -> tuple[str, float]:
        total, means = self.gains(text)
        if not total or not means:
            return UNKNOWN, 0.0
        best = max(range(len(means)), key=lambda i: (means[i], -i))
        weight = math.log(10) * min(total, SURE)
        return self.langs[best], 1.0 / sum(math.exp((m - means[best]) * weight) for m in means)


def predict(docs: DataFrame, model: dict, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1).

    Null text, text without a letter and a model without languages give ``und`` and 0.  Ties go to the language with more
    training words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    adds = StructType([StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        yield from appending(Scorer(sent.value), [text], adds)(batches)

    return docs.mapInArrow(run, appended(docs, adds))
