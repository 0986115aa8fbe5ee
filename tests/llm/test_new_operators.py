"""Hard negatives, collocations and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motionlake.llm import collocations, lines, negatives
from motionlake.session import settle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


# --- hard negatives


def usable(rows):
    return [
        (i, label, [math.floor(256 * float(x)) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]


def brute_negatives(rows, every=10, k=5):
    rows, out = usable(rows), []
    for own, label, v in {(i, label, tuple(v)) for i, label, v in rows if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i, other == label) for i, other, w in rows if i != own)
        for lower, positive, _ in [s for s in scores if s[2]][:5]:
            inside = [s for s in scores if not s[2] and -80 * lower <= -100 * s[0] <= -100 * lower][:k]
            out += [(own, positive, rank, i, -lower, -s) for rank, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def vectors():
    r = random.Random(1)
    rows = [(i * 5 if i % 4 else i * 10, r.randint(0, 2), [r.choice([-1.0, 0.0, 0.004, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(100, None, [1.0] * 4), (200, 1, None), (None, 1, [1.0] * 4), (300, 1, [1.0, None, 2.0, 0.0])]
    rows += [(300, 2, [float("nan")] * 4), (300, 2, [float("inf")] * 4), (800, 1, [2.0]), (800, 1, [2.0]), (801, 1, []), (900, 1, [-3.0] * 4)]
    # one vector in a third of all rows, of two labels
    rows += [(2000 + i, i % 2, [0.5] * 4) for i in range(100)]
    return rows


@pytest.mark.parametrize("block", [4096, 23])
def test_hard_negatives(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, label int, vector array<double>, anchor int, slot int")
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame(vectors(), "id long, label int, vector array<double>")
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("id") < 0).count() == 0


def test_inner_products_are_exact_beyond_doubles():
    x = np.array([[2.0**40, 3.0], [2.0**31, 1.0]])
    y = np.array([[2.0**20 + 1, -5.0], [2.0**45, 7.0]])
    want = [[min(sum(int(a) * int(b) for a, b in zip(p, q, strict=True)), 2**63 - 1) for q in y] for p in x]
    assert negatives.inner_products(x, y).tolist() == want


def test_blocks_meet_once_and_stay_small(spark):
    """Each (anchor, row) meets in one task, and no task gets more than some two blocks."""
    rows = settle(spark.range(1000).selectExpr("id", "0L as label", "array(1.0D) as vector"))
    anchors = rows.where("id < 100").selectExpr("*", "id as anchor")

    def meet(these, those):
        import pyarrow as pa

        return pa.table({"a": pa.array([len(these)]), "r": pa.array([len(those)])})

    met = negatives._grid(anchors, rows, 100, 1000, 50).applyInArrow(meet, "a long, r long").collect()
    assert sum(m.a * m.r for m in met) == 100 * 1000
    assert max(m.r for m in met) <= 100 and max(m.a for m in met) <= 100


# --- collocations


def brute_collocations(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    longest_holder = Counter()
    for (lang, w), v in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longest_holder[lang, w[i : i + m]] = max(longest_holder[lang, w[i : i + m]], v)
    out = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * longest_holder[lang, w] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def phrases():
    r = random.Random(2)
    words = ["a", "B", "b", "ü", "é", "q\x00", "zz", "long" * 9, "\U0001f600"]
    gaps = ["", "", "", "", ".", "\t", "  ", ",", "\n"]
    rows = [(i, " ".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 90))), r.choice(["en", "de", None])) for i in range(150)]
    rows += [(1, None, "en"), (2, "", "en"), (3, "...", "xx"), (4, "w" * 200_000 + " a b", "en"), (5, "a b a b " * 20_000, None)]
    return rows + [rows[3]] * 50


@pytest.mark.parametrize("how", [{}, {"held": 100, "bucket": 500}, {"hash_bits": 9, "held": 300}, {"hash_bits": 4}, {"most_bits": 64}, {"top": 7, "per_task": 14}], ids=str)
def test_collocations(spark, how):
    """Small blocks, fingerprints of few bits that collide all the time, a bit map that lets all through."""
    rows = phrases()
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, lang string, rank int, key int")
    got = sorted(map(tuple, collocations.collocations(df, least=10, **how).collect()))
    assert got == brute_collocations([(r[2], r[1]) for r in rows], 10, how.get("top", 2000)) and len(got) > 10


def test_collocations_without_rows(spark):
    df = spark.createDataFrame(phrases(), "doc_id long, text string, lang string")
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("text is null")).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    big = 5_000_000_000_000_000
    df = spark.createDataFrame([("en", ["a", "b"], big), ("en", ["a"], big + 1), ("en", ["b"], 2 * big)], "lang string, words array<string>, f long")
    row = collocations.scored(df).first()
    assert (row.a, row.l, row.r, row.score) == (big, big + 1, 2 * big, 2_000_000 * big // (3 * big + 1))


def test_collocation_entries_cost_the_same_in_many_buckets(spark, monkeypatch):
    """Buckets grow in number with the input; an entry must not carry more for it."""
    r = random.Random(5)
    rows = [("en", " ".join(f"w{r.randint(0, 400)}" for _ in range(30))) for _ in range(600)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    kept, real = [], collocations.frequent

    def frequent(packed, least):
        kept.append([bytes(x.entries) for x in packed.select("entries").collect()])
        return real(packed, least)

    monkeypatch.setattr(collocations, "frequent", frequent)

    def size(bucket):
        kept.clear()
        found = sorted(map(tuple, collocations.collocations(df, least=2, bucket=bucket).collect()))
        return [sum(len(pa.compress(b"".join(blobs), "lz4", asbytes=True)) for blobs in kept), max(map(len, kept)), found]

    few, one, whole = size(1 << 21)
    many, parts, found = size(300)
    assert parts > 20 * one and found == whole and len(found) > 100
    assert many < 1.5 * few


def test_collocation_words_are_found_in_later_rounds(spark):
    """All occurrences in one row, or in copies, and rounds that see few rows or none: every phrase is found."""
    rows = [("en", "a b c. " * 40), *[("de", f"x y {i % 3}") for i in range(90)], (None, "one two")]
    df = spark.createDataFrame(rows, "lang string, text string")
    packed = [collocations.frequent(collocations.entries(df.na.fill("und"), n, 1, None, 100, 64), 30) for n in (1, 2, 3)]
    found = settle(packed[0].union(packed[1]).union(packed[2]))
    for rounds in ((1,), (1 << 40, 1), (8, 2, 1)):
        got = {(x.lang, " ".join(x.words)): x.f for x in collocations.phrases_of(df.na.fill("und"), found, 3, rounds=rounds).collect()}
        numbers = {("de", p.format(i)): 30 for p in ("{}", "y {}", "x y {}") for i in range(3)}
        assert got == numbers | {("en", p): 40 for p in ("a", "b", "c", "a b", "b c", "a b c")} | {("de", p): 90 for p in ("x", "y", "x y")}
    with pytest.raises(ValueError, match="not found again"):
        collocations.phrases_of(df.where("lang = 'de'"), found, 3)


# --- lines


def brute_lines(rows, chars=20, docs=3):
    def key(line):
        return line.strip(SPACE).translate(LOWER)

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else []:
            held[key(line)].add(i)

    def stays(i, line):
        return i is None or len(key(line)) < chars or len(held[key(line)]) < docs or i == max(held[key(line)])

    return [(i, (text or "").split("\n"), [x for x in (text or "").split("\n") if stays(i, x)]) for i, text in rows]


def texts():
    rows = [
        (i % 7 if i % 5 else None, "\n".join([" Same Line in all of them here \r"] * (i % 3) + [f"line number {i % 4} is rather long"] * 70 + ["ü" * i]))
        for i in range(60)
    ]
    rows += [(100 + i, f"a line of two thirds of all documents\nown line of document {i}, long enough") for i in range(120)]
    return rows + [(300, None), (301, ""), (302, "\n\n"), (303, "x" * 300_000), (304, "a line of two thirds of all documents\n" * 5000)] + [rows[1]] * 3


@pytest.mark.parametrize("how", [{}, {"hot": 1, "tracked": 64}, {"hot": 2, "tracked": 8}], ids=str)
def test_lines(spark, how):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _keep int, pos int")
    want = brute_lines(rows)
    got = sorted(map(tuple, lines.line_digest(df, **how).collect()), key=str)
    assert got == sorted(((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, all_, kept in want), key=str)
    cut = lines.remove_repeated_lines(df, **how)
    assert cut.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in cut.collect()) == sorted((str(i), "\n".join(kept)) for i, _, kept in want)


def test_lines_without_rows_and_with_odd_names(spark):
    df = spark.createDataFrame(texts(), "`the.id` long, `a text` string")
    assert lines.remove_repeated_lines(df.limit(0), "the.id", "a text").count() == 0
    assert lines.remove_repeated_lines(df, "the.id", "a text").count() == df.count()


def test_bitmaps_are_compressed_and_native(spark):
    rows = spark.createDataFrame(texts(), "doc_id long, text string").where("doc_id is not null")
    found = lines.keep_bitmaps(rows.selectExpr("doc_id", "xxhash64(text) as text_hash", "text"))
    for r in found.collect():
        assert all(w.bits != -1 for w in r.keep) and len({w.word for w in r.keep}) == len(r.keep)
    plan = lines.line_digest(rows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
