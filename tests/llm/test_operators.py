"""Operators of the subpackage against brute force, with nulls, ties, repeats, empty and very long texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.llm import components, decontamination, language, lm, mixing, neardup, pii, quality, secrets, sharding, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(5)
VOCABULARY = ["".join(R.choices("abcdefgh", k=R.randint(2, 6))) for _ in range(300)]


def prose(n, r):
    return " ".join(r.choices(VOCABULARY, k=n))


def corpus():
    """Copies, near copies, shared passages, and odd rows."""
    r = random.Random(3)
    rows, passage = [], prose(80, r)
    for i in range(60):
        rows.append([i * 3, prose(r.randint(5, 150), r), "en", f"s{i % 4}"])
    for i in range(12):
        words = rows[0][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append([200 - i, " ".join(words), "en", "s0"])
        rows.append([300 + i, f"{prose(20, r)}\n{passage}\n{prose(20, r)}", "en", "s1"])
    rows += [[400, None, None, None], [401, "", "en", None], [402, " \n\t ", "en", "s2"], [403, rows[5][1], "en", "s3"]]
    rows += [[404, prose(30_000, r), "en", "s2"], [405, "x" * 200_000, "en", "s2"], [None, rows[5][1], None, "s1"], [406, "one", "en", "s1"]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_lookup_table_takes_turns_and_is_stable():
    names = [f"n{i}" for i in range(7)]
    size = sharding.table_size(7)
    table = sharding.lookup_table(names, size)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    # brute force: preference lists written out
    lists = [[(sharding._number(f"{n}:offset") + j * (sharding._number(f"{n}:skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner: dict[int, int] = {}
    while len(owner) < size:
        for shard, wishes in enumerate(lists):
            if len(owner) < size:
                owner[next(s for s in wishes if s not in owner)] = shard
    assert table == [owner[s] for s in range(size)]
    fewer = sharding.lookup_table(names[:-1], size)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 2 * size / 7 + size * 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 700)


def test_place(documents, rows):
    docs = documents(rows).selectExpr("*", "'x' as shard")
    placed = sharding.place(docs, ["a", "b", "c"])
    assert placed.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "slot", "shard"]
    table = sharding.lookup_table(["a", "b", "c"], sharding.table_size(3))
    got = placed.collect()
    assert len(got) == len(rows)
    for row in got:
        slot = int(hashlib.md5(("" if row.doc_id is None else str(row.doc_id)).encode()).hexdigest()[:15], 16) % len(table)
        assert (row.slot, row.shard) == (slot, table[slot])
    assert sharding.place(docs.limit(0), ["a"]).count() == 0


def waterfill(sizes, weights, percent, repeat):
    total, capped = sum(sizes) * percent / 100, set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(repeat * sizes[i] for i in capped)) / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if level * weights[i] > repeat * sizes[i]}
        if not over:
            return [repeat * s if i in capped else level * w for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        capped |= over


def test_mix(documents, rows):
    docs = documents([*rows, rows[7]])
    plan = mixing.mix_plan(docs).collect()
    sizes: Counter = Counter()
    for row in [*rows, rows[7]]:
        sizes[row[3]] += len(WORD.findall(row[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    goals = dict(zip(names, waterfill([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 150, 2), strict=True))
    source = {r[0]: r[3] for r in rows}
    assert len(plan) == len(rows) + 1
    for row in plan:
        assert row.target == pytest.approx(goals[source[row.doc_id]])
        assert row.source_size == sizes[source[row.doc_id]] and row.taken <= 2 * row.size
        rate = row.target / row.source_size if row.source_size else 0
        assert row.copies in (int(rate), int(rate) + 1)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in Counter(x for r in plan for x in [r.doc_id] * r.copies).items()})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_without_ids(documents):
    """Documents without id are drawn one by one, so a source of them meets its target."""
    r = random.Random(12)
    docs = documents([(None if s == "c" else i, prose(30, r), "en", s) for i in range(300) for s in "abc"])
    plan = mixing.mix_plan(docs).where("doc_id is null").collect()
    assert abs(sum(x.taken for x in plan) - plan[0].target) < 0.1 * plan[0].target
    assert len({x.copies for x in plan}) == 2 and mixing.mix(docs).count() == sum(x.copies for x in mixing.mix_plan(docs).collect())


def test_clashing_names(documents, rows):
    """Columns that operators use inside, and names with a dot, pass through."""
    docs = documents(rows).withColumn("_slot", F.lit(5)).withColumn("_id", F.lit(6)).withColumn("a.b", F.lit(7))
    placed = sharding.place(docs, ["x", "y", "z"])
    assert placed.columns == [*docs.columns, "slot", "shard"]
    assert {tuple(x) for x in placed.select("_slot", "_id", "`a.b`").distinct().collect()} == {(5, 6, 7)}
    assert {x.doc_id: x.shard for x in placed.collect()} == {x.doc_id: x.shard for x in sharding.place(documents(rows), ["x", "y", "z"]).collect()}
    one = neardup.dedup(docs.drop("a.b"))
    assert one.columns == docs.columns[:-1] and one.count() == neardup.dedup(documents(rows)).count()


def test_secrets_sample_is_merged_in_parts(spark):
    """The smallest hashes of a label, found by a bounded merge and not by a window over all findings."""
    found = [(i % 2, (i * 7919) % 5003, f"w{i % 11}") for i in range(20_000)]
    rows = spark.createDataFrame(found, "label int, hash long, seen string").repartition(16)
    got = secrets.first_windows(rows, 1, 1500)
    assert [tuple(x) for x in got.collect()] == sorted(x for x in found if x[0] == 1)[:1500]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def test_quality_counts_by_brute_force(rows):
    for text in [r[1] for r in rows] + ["a b c a b c", "x\nx\ny z\nx", "1 1 1 1"]:
        words = WORD.findall(text or "")
        if len(words) > 3000:
            continue
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert quality.text_statistics(text)[:5] == (
            len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(hit)
        )


def test_quality_lines(documents):
    r = random.Random(9)
    line, other = "Follow us on page 12 for more", prose(60, r)
    rows = [(i, f"{prose(70, r)}\n{line}\n", "en", "host") for i in range(30)]
    rows += [(100 + i, f"{prose(3, r)} x{i} \n{other}", "en", "host") for i in range(30)] + [(200, f"{prose(60, r)}\n{line}", "en", "else"), (300, None, "en", "host")]
    docs = documents(rows)
    got = {x.doc_id: x for x in quality.verdicts(docs).collect()}
    assert not got[0].n_removed and all(got[i].n_removed == 7 and got[i].kept for i in range(1, 30))
    assert got[100].kept and not any(got[i].kept or got[i].base_failed for i in range(101, 130))
    assert got[200].kept and got[200].n_removed == 0 and got[300].base_failed and not got[300].kept
    kept = {x.doc_id: x for x in quality.clean(docs.fillna(7, ["n_chars"])).collect()}
    assert set(kept) == {*range(30), 100, 200} and line in kept[0].text and line not in kept[1].text
    assert kept[1].n_chars == len(kept[1].text) and kept[0].n_chars == 7
    assert quality.clean(docs.limit(0)).count() == 0


def test_quality_passage_stays_once(documents):
    """The first document of a line may be rejected; the line then stays in another that is kept."""
    r = random.Random(21)
    lines = {c: prose(n, r) for c, n in {"a": 12, "b": 60, "c": 12, "d": 40, "e": 40}.items()}
    own = lambda i, n: f"{prose(n, r)} own{i}"
    rows = [(0, lines["a"], "en", "short")] + [(i, f"{own(i, 70)}\n{lines['a']}", "en", "short") for i in range(1, 26)]
    # most of each text is shared with a page that is too short
    rows += [(100, lines["d"], "en", "most")] + [(100 + i, f"{own(i, 12)}\n{lines['d']}\n{lines['e']}", "en", "most") for i in range(1, 26)]
    # document 201 is the first with line c and is depleted by line b, which 200 keeps
    rows += [(200, f"{own(0, 20)}\n{lines['b']}", "en", "depleted"), (201, f"{own(1, 20)}\n{lines['b']}\n{lines['c']}", "en", "depleted")]
    rows += [(202 + i, f"{own(i, 20)}\n{lines['b']}", "en", "depleted") for i in range(25)] + [(250 + i, f"{own(i, 70)}\n{lines['c']}", "en", "depleted") for i in range(25)]
    # null ids and a null host
    rows += [(None, f"{own(i, 70)}\n{lines['a']}", "en", None) for i in range(22)]
    docs = documents(rows)
    kept = [(x.doc_id, x.source, x.text) for x in quality.clean(docs).collect()]
    assert {(i, c) for i, s, t in kept for c, line in lines.items() if s and line in t.split("\n")} == {(1, "a"), (101, "d"), (101, "e"), (200, "b"), (250, "c")}
    assert sorted(i for i, s, _ in kept if s) == [*range(1, 26), 101, 200, *range(250, 275)]
    assert sum(s is None and lines["a"] in t for _, s, t in kept) == 22


def test_quality_counts_documents_at_any_size(documents):
    """Identical pages count one by one, the limit is the same in large hosts, and a line's first document passes the base rules."""
    r = random.Random(33)
    page, line, rare = prose(80, r), prose(8, r), prose(9, r)
    rows = [(i, page, "en", "pages") for i in range(10_000)]
    rows += [(20_000 + i, f"{prose(55, r)} n{i}" + f"\n{line}" * (i < 21) + f"\n{rare}" * (i < 20), "en", "large") for i in range(4_500)]
    rows += [(19_999, line, "en", "large")]
    got = {x.doc_id: x for x in quality.verdicts(documents(rows)).select("doc_id", "n_removed", "base_failed", "kept").collect()}
    assert [i for i in range(10_000) if got[i].kept] == [0] and got[1].n_removed == 80
    assert got[19_999].base_failed and got[20_000].n_removed == 0
    assert all(got[20_000 + i].n_removed == 8 for i in range(1, 21)) and all(got[20_000 + i].kept for i in range(4_500))
    assert not any(got[20_000 + i].n_removed for i in range(21, 4_500))


def test_quality_joins_without_bloom_filters(documents, spark, tmp_path):
    """Runtime filters of a megabyte for each key would go through the driver into the closures of the last job."""
    r = random.Random(41)
    line = prose(9, r)
    documents([(i, f"{prose(60, r)} n{i}\n{line}", "en", "host") for i in range(25)]).write.parquet(path := f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else the few rows are broadcast
    try:
        cleaned = quality.clean(spark.read.parquet(path))
        plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "might_contain" not in plan
    texts = {x.doc_id: x.text for x in cleaned.collect()}
    assert len(texts) == 25 and [i for i, t in texts.items() if line in t] == [0]


def test_quality_holders_take_few_rounds(spark, monkeypatch):
    """A chain in which each document holds a line and the next one: rounds don't follow its length."""
    n = 150
    held = [((i, "host", i), ("host", line), words, 100) for i in range(n) for line, words in ((i, 60), (i + 1, 35)) if line < n]
    df = spark.createDataFrame(held, "doc struct<doc_id:long,source:string,text_hash:long>, key struct<source:string,line:long>, words long, n_words long")
    rounds = []
    real = quality.counted
    monkeypatch.setattr(quality, "counted", lambda *a, **k: rounds.append(1) or real(*a, **k))
    first = {r.key.line: r.first for r in quality._holders(df).collect()}
    assert len(rounds) <= 14
    lost = Counter()
    for doc, key, words, _ in held:
        lost[doc[0]] += words * (first.get(key[1]) is not None and first[key[1]] != doc[0])
    assert all(2 * lost[doc] <= 100 for doc in first.values())
    assert all(line in first or all(2 * lost[doc[0]] > 100 for doc, key, *_ in held if key[1] == line) for line in range(n))


def brute_groups(rows, k):
    sets = {}
    for id, text, *_ in rows:
        w = WORD.findall(decontamination.ascii_lower(text)) if text else []
        k2 = min(k, len(w))
        sets[id] = {tuple(w[i : i + k2]) for i in range(len(w) - k2 + 1)} if w else set()
    top = {i: i for i in sets if i is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(top)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(documents, rows, k):
    docs = documents(rows)
    got = neardup.groups(docs, k=k).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == brute_groups(rows, k)
    assert [(x.component_id, x.kept) for x in got if x.doc_id is None] == [(None, True)]
    kept = neardup.dedup(docs.union(docs.where("doc_id = 3")), k=k)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(i for i, (_, c) in brute_groups(rows, k).items() if i == c)
    assert neardup.groups(docs.limit(0)).count() == 0


def test_links_that_the_star_misses(documents):
    """A chain in which neighbours are similar and the ends are not, so that no member links to all."""
    r = random.Random(1)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(20):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.groups(documents(rows), k=2).collect()}
    assert got == brute_groups(rows, 2)


def test_units_find_every_link_between_components():
    """Small blocks of members, tested by hand-made signatures."""
    r = np.random.default_rng(2)
    base = r.integers(0, 2**62, 100)
    members = []
    for i in range(12):
        own = base.copy()
        own[: i * 2] = r.integers(0, 2**62, i * 2)
        members.append((i, i, True, True, bytes(200), np.unique(own)))
    top = {i: i for i in range(12)}
    for a, b in neardup.test_unit(members):
        top = {k: min(top[a], top[b]) if v in (top[a], top[b]) else v for k, v in top.items()}
    assert top == {i: 0 if i <= 5 else i for i in range(12)}  # (100 - 2 i) / (100 + 2 i) to the first, less to each other
    assert len(neardup.hopeful_unit([m[:5] for m in members])) == 11


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(500, 560)] + [(9, 9), (None, 3)]
    top = {x: x for e in edges if None not in e for x in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                top[a] = top[b] = min(top[a], top[b])
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {k: v for k, v in top.items() if k in linked}


def test_substrings(documents, rows):
    got = {x.doc_id: x for x in substrings.repeat_digest(documents(rows)).collect() if x.doc_id is not None}
    first: dict = {}
    texts = {r[0]: WORD.findall(r[1] or "") for r in rows if r[0] is not None}
    for id in sorted(texts):
        for i in range(len(texts[id]) - 49):
            first.setdefault(tuple(texts[id][i : i + 50]), id)
    for id, words in texts.items():
        gone = {i + k for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < id for k in range(50)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (got[id].n_words, got[id].n_removed, got[id].kept_sha256) == (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert any(x.n_removed for x in got.values())
    assert {x.text for x in substrings.remove_repeats(documents([(1, None), (2, "a  b")])).collect()} == {None, "a b"}
    assert substrings.repeat_digest(documents([])).count() == 0


def test_substrings_of_one_bucket_are_dealt_by_window(documents):
    """One shared line with different words around it: many strings of one minimiser, which no task receives as a whole."""
    r = random.Random(17)
    line = prose(45, r)
    rows = [(i, " ".join([*(f"a{i}.{k}" for k in range(40)), line, *(f"z{i}.{k}" for k in range(40))])) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200, "x " + rows[3][1].split(" ", 5)[5])]
    got = {x.doc_id: x.n_removed for x in substrings.repeat_digest(documents(rows)).collect()}
    assert got == {i: 125 if 100 <= i < 200 else 120 if i == 200 else 0 for i, _ in rows}
    windows = substrings._windows(documents(rows).selectExpr("doc_id as id", "text"), documents(rows).sparkSession.createDataFrame([], "first long, key binary, start int, n int"), 50)
    assert "mini" not in windows.columns


def test_decontamination(documents, spark, rows):
    long = prose(300, random.Random(8))
    items = [(1, " ".join(rows[2][1].split()[3:30])), (2, "changed"), (3, None), (4, "!!"), (None, long), (5, long), (5, "not there at all")]
    docs = documents([*rows, (500, long.upper()), (501, " ".join(long.split()[:20]))])
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = decontamination.item_words
    want = {}
    for id, text, *_ in [*rows, (500, long.upper()), (501, " ".join(long.split()[:20]))]:
        words, hit, named = word(text), set(), set()
        for item, pattern in items:
            w = word(pattern)
            m = min(13, len(w))
            windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
            for i in range(len(words) - m + 1) if m else ():
                if tuple(words[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    named.add("" if item is None else str(item))
        want[id] = (len(words), len(hit), sorted(named), len(hit) > 0 and 20 * len(hit) >= len(words))
    for block in (200_000, 100):
        got = decontamination.contamination(docs, bench, block_words=block).collect()
        assert {x.doc_id: (x.n_words, x.n_hit, x.items, x.contaminated) for x in got} == want
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {i for i, w in want.items() if not w[3]}
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_scores(rows, order):
    """Per row ``(id, words, backed off, log score in millionths)`` by dictionaries."""
    tokens = [WORD.findall(r[1] or "") for r in rows]
    grams = [[tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1)] for t in tokens]
    counts = Counter(g for own in grams for g in own)
    total = sum(map(len, tokens))
    for row, t, own in zip(rows, tokens, map(Counter, grams), strict=True):
        score = backed = 0
        for i in range(len(t)):
            context = min(order - 1, i)
            for k in range(context, -1, -1):
                gram = tuple(t[i - k : i + 1])
                if k and counts[gram] == own[gram]:
                    continue
                n, of = (counts[gram] - own[gram], counts[gram[:-1]]) if k else (counts[gram], total)
                score += round(1e6 * np.log10(0.4 ** (context - k) * n / of))
                backed += k < context
                break
        yield row[0], len(t), backed, score


def test_lm(documents, rows):
    for order, block in ((1, 100_000), (2, 10_000), (3, 3_000), (3, 10**9), (4, 20_000)):
        got = {x.doc_id: x for x in lm.score(documents(rows), order=order, block_bytes=block).collect()}
        for id, n, backed, score in brute_scores(rows, order):
            assert (got[id].n_words, got[id].n_backed_off) == (n, backed) and got[id].log_score == pytest.approx(score / 1e6, abs=1e-6 * max(1, n))
            assert got[id].mean_log_score is None if not n else got[id].mean_log_score == pytest.approx(got[id].log_score / n)
    assert lm.score(documents([])).count() == 0


def test_lm_counts_every_word(documents, spark):
    """Rare words are told apart, rows of one id add up, and a text that another repeats scores above one that nobody has."""
    r = random.Random(4)
    alone = " ".join(f"a{i}" for i in range(80))
    twice = " ".join(f"b{i}" for i in range(80))
    rows = [(1, alone, "en", "x"), (2, twice, "en", "x"), (3, twice, "en", "y"), (4, None, None, None), (None, "c d c d", "en", "x"), (None, "c d", "en", "x"), (5, "", "en", "x")]
    rows += [(10 + i, prose(80, r), "en", "x") for i in range(20)] + [(7, prose(9, r), "en", "x")] * 40
    got = {x.doc_id: x for x in lm.score(documents(rows), block_bytes=500).collect()}
    assert got[2].n_backed_off == got[3].n_backed_off == 0 and got[1].n_backed_off == 79
    assert got[2].mean_log_score > max(x.mean_log_score for i, x in got.items() if x.n_words and i is not None and i not in (2, 3, 7))
    want = Counter()
    for id, n, backed, score in brute_scores(rows, 3):
        want[id, "n"] += n
        want[id, "backed"] += backed
        want[id, "score"] += score
    assert all((x.n_words, x.n_backed_off) == (want[i, "n"], want[i, "backed"]) and round(1e6 * x.log_score) == pytest.approx(want[i, "score"], abs=40) for i, x in got.items())
    blocks = lm.in_blocks(documents(rows), "doc_id", "text", 500)
    keys = lm.gram_rows(blocks, 1).where(f"key <> {lm.EMPTY}").select("key").distinct().count()
    assert keys == len({w for _, t, *_ in rows for w in WORD.findall(t or "")})


def test_lm_travels_packed(documents):
    """N-grams take less than 7 bytes on the way to their parts, answers less than 1, texts less than their half."""
    r = random.Random(5)
    rows = [(i, prose(400, r) if i % 3 else None, "en", "x") for i in range(400)]
    docs = documents(rows).repartition(3)
    blocks = lm.in_blocks(docs, "doc_id", "text", 100_000).cache()
    texts = lm.text_bytes(docs, "text")
    assert blocks.count() > 3 and blocks.selectExpr("sum(length(rows))").first()[0] < texts / 2
    grams = lm.gram_parts(blocks, 3, 5).cache()
    size, sent = grams.selectExpr("sum(size)", "sum(length(keys) + length(counts))").first()
    assert grams.select("part").distinct().count() == 5 and sent < 7 * size
    assert lm.replies(grams).selectExpr("sum(length(others))").first()[0] < size
    counts, known = defaultdict(int), lm.gram_rows(blocks, 3).collect()
    assert len(known) == size == len({(x.key, x.block) for x in known})
    for x in known:
        counts[x.key] += x.n
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    want = Counter(tuple(w[i : i + k]) for w in words for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert sorted(counts.values()) == sorted([*want.values(), sum(map(len, words))])
    assert (lm.unpacked(lm.packed(np.array([0, 7, 2**63])), 3) == [0, 7, 2**63]).all()


def test_language(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out(docs["doc_id"])
    model = language.train(docs.where(~held))
    got = language.predict(docs.withColumn("held", held), model).where("held").collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.97 and all(0 <= x.score <= 1 for x in got)
    odd = {x.doc_id: x for x in language.predict(documents([(1, None), (2, ""), (3, "12 !! ²"), (None, "the " * 50_000)]), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, None)] == ["und", "und", "und", "en"]
    # brute force: words first, then the longest known n-grams
    scorer = language.Scorer(model)
    text = "The zzqx thereofing"
    sums = defaultdict(float)
    for word in language.letter_words(text):
        known = dict(model["kept"][0].get(word, ()))
        for n in (4, 3, 2, 1):
            if not known:
                parts = [model["kept"][n][g] for g in language.grams(word, n) if g in model["kept"][n]]
                known = {i: sum(dict(p).get(i, 0) for p in parts) / len(parts) for i in range(len(model["langs"]))} if parts else {}
        for i, gain in known.items():
            sums[i] += gain
    assert scorer.gains(text) == (3, pytest.approx([sums[i] / 3 for i in range(len(model["langs"]))]))
    empty = language.train(docs.limit(0))
    assert language.predict(documents([(1, "abc")]), empty).first().lang_pred == "und"


PII_TEXT = "mail a.b+c@x-y.example.com or @no.where, 10.0.0.255 and 1.2.3.999 pay 4111 1111-1111 1111 call +1 (555) 010-9999x +12 a@b.c@d.e 00000000000000000000000"


def test_pii_base(rows):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    r = random.Random(6)
    alphabet = ["1", "4", "00", ".", "..", "@", "+", "-", " ", "a", "é", "(", "255", "4111111111111111", "a@b.c", "1.2.3.4"]
    for text in [PII_TEXT] + ["".join(r.choices(alphabet, k=40)) for _ in range(400)]:
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                    continue
                if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                    continue
                if kind == "phone" and not 9 <= len(digits) <= 15:
                    continue
                want.append((kind, *m.span()))
        assert pii.base_spans(text) == want
    assert pii.base_spans("1" * 100_000 + "@" + "a" * 100_000) == []


def test_pii_added(documents):
    text = "account DE89370400440532013000, bad DE88370400440532013000, SSN 123-45-6789 then far away " + "x " * 40 + "123-45-6788"
    assert [s[0] for s in pii.find_spans(text)] == ["iban", "ssn"]
    assert pii.redact(documents([(1, "to a@b.cd!"), (2, None)])).select("text").collect() == [("to [EMAIL]!",), (None,)]
    assert pii.find(documents([])).count() == 0


def test_pii_iban_among_other_words():
    solid, spaced, short = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947"
    for iban in (solid, spaced, short, "XX36" + "1" * 14 + "2"):
        if iban.startswith("XX"):  # a country without a known length
            iban = next(x for n in range(100) if pii.mod97(x := f"XX{n:02d}{'1' * 14}2"))
        for before in ("", "account ", "REF AB12 ", "NR 4711 "):
            for after in ("", ", x", " BIC COBADEFFXXX", " 12 May", " USD 500", " A payment", " to", " 1", " AB12"):
                text = before + iban + after
                assert [text[a:b] for kind, a, b in pii._added(text) if kind == "iban"] == [iban], text
                assert iban not in pii.redacted(text)[0]
    assert [s[1:] for s in pii._added(f"{short} {short}")] == [(0, 15), (16, 31)]
    assert pii._added("DE88370400440532013000 BIC COBADEFFXXX") == []


def test_secrets(documents):
    r = random.Random(7)
    text = 'API_key: "abcdef" token=abc paſſword=abcdefg AKIA' + "A1" * 9 + " " + "ab12" * 6 + " x"
    base = secrets.base_spans(text)
    assert [s[0] for s in base] == ["assign", "access", "hex"] and all(text[a:b] in text for _, a, b in base)
    docs = documents([(i, prose(30, r) + f" password={'%032x' % r.getrandbits(128)} " + prose(10, r)) for i in range(40)] + [(90, None), (91, "")])
    model = secrets.train(docs)
    fresh = secrets.generated(200, seed=123)
    scan = secrets.Network()
    scan.p = model["weights"]
    p = 1 / (1 + np.exp(-(model["slope"] * scan.logits(secrets.encode([w for w, _ in fresh])) + model["offset"])))
    labels = np.array([label for _, label in fresh])
    assert (p[labels == 1] >= model["threshold"]).mean() > 0.95 and (p[labels == 0] >= model["threshold"]).mean() < 0.05
    found = {x.doc_id: x.found for x in secrets.find(documents([(1, "see ghp_" + "aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1zA3bC5" + " now"), (2, None)]), model=model).collect()}
    assert [s.kind for s in found[1]] == ["learned"] and found[2] == []


def test_secrets_corpus_negatives(documents):
    """Drawn tokens outside base spans are no negatives; words, dates and UUIDs are."""
    r = random.Random(12)
    alnum = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    shapes = [("ghp_", alnum, 36), ("sk_live_", alnum, 24), ("glpat-", alnum + "_-", 20), ("AIza", alnum + "_-", 35), ("", alnum + "+/", 40), ("", alnum[:10] + alnum[36:], 32)]
    for start, alphabet, n in shapes:
        drawn = [start + "".join(r.choices(alphabet, k=n)) for _ in range(1000)]
        assert sum(label == 0 for t in drawn for label, *_ in secrets._labelled(f"see {t} now")) <= 5
    for t in ("some-article-name-2024", "v1/projects/production/services/12", "UserAccountManager42", "550e8400-e29b-41d4-a716-446655440000", "2024-05-12T10-30-00Z"):
        assert [label for label, *_ in secrets._labelled(f"see {t} now")] == [0]
    tokens = ["ghp_" + "".join(r.choices(alnum, k=36)) for _ in range(300)]
    model = secrets.train(documents([(i, f"see {t} now") for i, t in enumerate(tokens)]))
    scan = secrets.Scanner(model)
    assert sum(bool(scan(f"see {t} now")) for t in tokens) >= 294


def test_secrets_in_long_candidates(documents):
    """The token is found wherever it stands in a candidate; long paths of words stay unmarked."""
    r = random.Random(13)
    alnum = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    scan = secrets.Scanner(secrets.train(documents([(1, None)])))
    leads = ["DATABASE_PRODUCTION_CONNECTION_SERVICE_ACCOUNT_CREDENTIAL=", "v1/projects/production/services/integrations/webhooks/", "some/very/long/path/" * 12]
    for lead in leads:
        texts = [f"see {lead}{''.join(r.choices(alnum, k=40))} now" for _ in range(100)]
        found = [[s[:3] for s in scan(t)] for t in texts]
        assert sum(f == [("learned", 4, len(t) - 4)] for f, t in zip(found, texts, strict=True)) >= 95
        assert scan(f"see {lead}reports/monthly/overview12 now") == []
    for start, end in ((0, 16), (5, 53), (5, 54), (0, 1000)):
        covered = [x for a, b in secrets.pieces(start, end) for x in range(a, b)]
        assert set(covered) == {*range(start, end)} and all(b - a <= secrets.WITHIN for a, b in secrets.pieces(start, end))


def test_secrets_threshold_per_kind():
    labels, kinds = np.array([1.0] * 100 + [0.0] * 50), np.array([0] * 90 + [1] * 10 + [0] * 50)
    p = np.concatenate([np.full(90, 0.9), np.full(10, 0.3), np.full(50, 0.1)])
    assert (p[90:100] >= secrets.threshold(p, labels, kinds, recall=0.9)).all()


def test_network_gradients():
    net, r = secrets.Network(), np.random.default_rng(0)
    codes, labels = r.integers(0, 60, (4, secrets.LENGTH)), np.array([0.0, 1, 1, 0])

    def loss():
        z = net.forward(codes)[-1]
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    g = net.gradients(codes, labels)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3)
