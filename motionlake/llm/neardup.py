"""Near-duplicates by MinHash.

Many universal hash minima of a document's word shingles are cut into bands; documents sharing a band are candidates.
Signatures reject the hopeless ones, full shingle sets confirm the others, and links become groups by alternating
large-star and small-star.

Groups of copies are never paired within themselves.  Documents with equal sets are one class and only its smallest id goes
on.  A bucket first links its members to the one that meets most others (a star).  Only where members of one bucket are
still in different components their pairs are tested too, inside tasks, so no link between components is lost: every pair
that shares a band is joined by links, or tested, and 40 bands of 5 minima miss a pair at similarity 0.8 with a chance of
one in eight million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from motionlake.session import settle

from .common import SLICE, WORD, WordHashes, ascii_lower, field, fresh, settled
from .components import components

#: Links: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
SHINGLE = 5
BANDS, ROWS = 40, 5
#: Bits of the map of candidate ids.
BITS = 1 << 24
#: Shingles of a block of bucket members.
BLOCK = 1_000_000
SEED = 7

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``k`` words; of fewer words, the whole sequence is the only one."""
    words = WORD.findall(ascii_lower(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    own = hashes.array(words)
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _ODD + own[i : len(words) - k + 1 + i])
    return np.unique(out)


def universal(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` hash functions ``(a * x + b) mod 2**64``, of which the high half counts."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, n, np.uint64) | np.uint64(1), r.integers(0, 2**64, n, np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(a), len(sets)), np.uint64)
    for i in range(len(a)):
        out[i] = np.minimum.reduceat(flat * a[i] + b[i], starts)
    return (out >> np.uint64(32)).T



_SIGNED = StructType([
    StructField("n_shingles", LongType()), StructField("print", BinaryType()), StructField("sig", BinaryType()), StructField("bands", ArrayType(LongType())),
])


def signatures(sets: list[np.ndarray], functions: tuple[np.ndarray, np.ndarray], bands: int, rows: int) -> tuple[list, list, list]:
    """Fingerprint, signature (low bytes of the minima) and band keys of each set; of an empty set nothing."""
    full = [i for i, s in enumerate(sets) if len(s)]
    prints, sigs, keys = [None] * len(sets), [None] * len(sets), [[]] * len(sets)
    if full:
        least = minima([sets[i] for i in full], *functions)
        banded = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands))
        for r in range(rows):
            banded = _mixed(banded * _ODD + least[:, r::rows])
        low, banded = least.astype(np.uint8), banded.astype(np.int64)
        for at, i in enumerate(full):
            prints[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            sigs[i] = low[at].tobytes()
            keys[i] = banded[at]
    return prints, sigs, keys


def _sign(k: int, bands: int, rows: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, functions = WordHashes(), universal(bands * rows)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                sets = [shingle_set(t, k, hashes) for t in part.column(1).to_pylist()]
                prints, sigs, keys = signatures(sets, functions, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))], schema=schema,
                )

    return run


def sign(rows: DataFrame, k: int, bands: int = BANDS, height: int = ROWS) -> DataFrame:
    """``id``, set size, fingerprint of the set, signature (low bytes of the minima) and band keys of each text."""
    import pyspark.sql.pandas.types as arrow_types

    out = StructType([StructField("id", rows.schema["id"].dataType), *_SIGNED])
    return rows.select("id", "text").mapInArrow(_sign(k, bands, height, arrow_types.to_arrow_schema(out)), out)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` (column ``id``).

    A bit map of ``BITS`` hashed ids, the same size for any input, keeps most other texts out of the join's shuffle; the
    join makes it exact.
    """
    spot = lambda: F.pmod(F.xxhash64("id"), F.lit(BITS))
    words = ids.select(spot().alias("s")).groupBy(F.shiftright("s", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits"))
    set_words = words.toArrow()
    bits = np.zeros(BITS >> 5, np.uint32)
    bits[set_words.column("at").to_numpy()] = set_words.column("bits").to_numpy().astype(np.uint32)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((held[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)).select([0, 1])

    marked = rows.select("id", "text", spot().alias("spot")).where("id is not null")
    return marked.mapInArrow(run, marked.drop("spot").schema).join(ids, "id", "left_semi")


def _sets(rows: DataFrame, k: int, signed: bool = False) -> DataFrame:
    """``id, set``, or ``id, sig, bands, set``, of each text."""
    import pyspark.sql.pandas.types as arrow_types

    out = StructType([StructField("id", rows.schema["id"].dataType), *(_SIGNED[2:] if signed else []), StructField("set", ArrayType(LongType()))])
    schema = arrow_types.to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, functions = WordHashes(), universal(BANDS * ROWS)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                sets = [shingle_set(t, k, hashes) for t in part.column(1).to_pylist()]
                more = []
                if signed:
                    _, sigs, keys = signatures(sets, functions, BANDS, ROWS)
                    more = [pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *more, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema
                )

    return rows.select("id", "text").mapInArrow(run, out)


def _least(n: int) -> float:
    """Agreements of ``n`` that a link has but for six standard deviations."""
    return n * SIMILAR / 100 - 6 * (n * SIMILAR / 100 * (1 - SIMILAR / 100)) ** 0.5


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree as often as a link's do."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((one == two).sum(1) >= _least(one.shape[1])))


def confirmed(pairs: DataFrame, base: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The pairs ``a, b`` that are links: sizes and signatures first, then full sets."""
    small = base.select("id", "n_shingles", "sig")
    one, two = small.toDF("a", "na", "sa"), small.toDF("b", "nb", "sb")
    near = pairs.join(one, "a").join(two, "b").where("100 * least(na, nb) >= %d * greatest(na, nb)" % SIMILAR)
    kind = base.schema["id"].dataType
    hopeful = settled(near.select("a", "b", "sa", "sb").mapInArrow(_hopeful, StructType([StructField("a", kind), StructField("b", kind)])).distinct())
    named = hopeful.select(F.col("a").alias("id")).union(hopeful.select("b")).distinct()
    sets = _sets(_only(rows, named), k)
    both = hopeful.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("n", shared).where(F.col("n") * 100 >= (F.size("x") + F.size("y") - F.col("n")) * SIMILAR).select("a", "b").distinct()


def links(base: DataFrame, leading: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``id, component`` of every class representative that is linked to another.  ``base``: signed rows, ``leading``: the
    representatives' ids."""
    bands = base.select("id", "bands").join(leading, "id", "left_semi").select("id", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").drop("x", "y")
    shared = settled(bands.join(sizes, "key"))
    # the member that shares most buckets with others is nearest to the middle of its group
    degrees = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    leaders = shared.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", "id"))["id"].alias("leader"))
    led = shared.select("key", "id").join(leaders, "key").where("id <> leader")
    star = led.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    found = settled(components(confirmed(star, base, rows, k)))
    more = open_links(shared.select("key", "id"), found, base, rows, k)
    return components(more.union(found.select("id", "component")))


def open_links(shared: DataFrame, found: DataFrame, base: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Links ``a, b`` between members of one bucket that are in different components so far.

    Members outside a bucket's largest component are compared with all members of other components, in units of two blocks
    of bounded size: signatures first, then full sets.  A unit returns only links that join components.
    """
    placed = shared.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("c")).where("c > 1")
    open_rows = placed.join(mixed.drop("c"), "key").select("key", "id", "component", (F.col("component") != F.col("main")).alias("out"))
    open_rows = settled(open_rows.join(base.select("id", "n_shingles"), "id"))
    kind = base.schema["id"].dataType
    pairs = StructType([StructField("a", kind), StructField("b", kind)])
    hopeful = _dealt(_units(open_rows), base.select("id", "sig")).mapInArrow(_in_units(hopeful_unit), pairs)
    # pairs worth a full test meet in one cluster, so a set travels once and not with each bucket
    clusters = settled(components(hopeful).toDF("id", "key"))
    named = open_rows.select("id", "component", "n_shingles").distinct().join(clusters, "id")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    members = settled(named.join(main, "key").withColumn("out", F.col("component") != F.col("main")))
    signed = _sets(_only(rows, members.select("id").distinct()), k, signed=True).drop("bands")
    return _dealt(_units(members), signed).mapInArrow(_in_units(test_unit), pairs)


def _units(members: DataFrame) -> DataFrame:
    """``key, i, j, id, component, asks, answers``: the members' places in units.

    A bucket's members are cut into blocks of about ``BLOCK`` shingles by hash; unit (i, j) has the outsiders of block i,
    who ask, and all members of block j, who answer.
    """
    blocks = members.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / BLOCK)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = members.join(blocks, "key").withColumn("block", mine)
    unit = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    asking = F.when(F.col("out"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: unit(F.col("block"), x)))
    answering = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: unit(x, F.col("block")))
    places = members.withColumn("unit", F.explode(F.array_distinct(F.concat(answering, F.coalesce(asking, F.slice(answering, 1, 0))))))
    return places.select(
        "key", "unit.i", "unit.j", "id", "component", (F.col("out") & (F.col("unit.i") == F.col("block"))).alias("asks"),
        (F.col("unit.j") == F.col("block")).alias("answers"),
    )


def _dealt(units: DataFrame, wide: DataFrame) -> DataFrame:
    """The units' rows with what is known of each id; only this shuffle carries signatures and sets."""
    return units.join(wide, "id").select("key", "i", "j", "id", "component", "asks", "answers", *wide.drop("id").columns).repartition(
        "key", "i", "j"
    ).sortWithinPartitions("key", "i", "j")


def _in_units(work):
    """Calls ``work(members)`` on the rows of each unit, which arrive one after another; gives pairs ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, ids = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if found := work(held):
                yield pa.RecordBatch.from_arrays([pa.array(c, ids) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            ids = batch.schema.field(3).type
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                plain = [part.column(i).to_pylist() for i in range(8)]
                for at, (key, i, j, *row) in enumerate(zip(*plain, strict=True)):
                    if (key, i, j) != unit:
                        if held:
                            yield from done()
                        unit, held = (key, i, j), []
                    held.append((*row, part.column(8)[at].values.to_numpy()) if part.num_columns > 8 else tuple(row))
        if held:
            yield from done()

    return run


def hopeful_unit(members: list[tuple]) -> list[tuple]:
    """Pairs that tie each member (``id, component, asks, answers, sig``) to those elsewhere whose signatures agree.

    All such pairs would do; a chain of first meetings ties the same members with fewer rows.  A member is compared only
    with members it is not tied to yet.
    """
    askers = [at for at, m in enumerate(members) if m[2]]
    others = np.array([at for at, m in enumerate(members) if m[3]], np.int64)
    if not askers or not len(others):
        return []
    sigs = np.frombuffer(b"".join(m[4] for m in members), np.uint8).reshape(len(members), -1)
    least = _least(sigs.shape[1])
    part = np.unique([m[1] for m in members], return_inverse=True)[1].reshape(-1)
    tie = np.arange(len(members))
    found = []
    for at in askers:
        apart = others[(tie[others] != tie[at]) & (part[others] != part[at])]
        near = apart[(sigs[apart] == sigs[at]).sum(1) >= least]
        while len(near):
            found.append((members[at][0], members[near[0]][0]))
            tie[tie == tie[near[0]]] = tie[at]
            near = near[tie[near] != tie[at]]
    return found


def test_unit(members: list[tuple]) -> list[tuple]:
    """Links between askers and answerers (``id, component, asks, answers, sig, set``) that join components.

    A pair is tested while its members are not joined yet, the most promising first.
    """
    askers, others = [m for m in members if m[2]], [m for m in members if m[3]]
    root: dict = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    if not askers or not others:
        return []
    sigs = np.frombuffer(b"".join(m[4] for m in others), np.uint8).reshape(len(others), -1)
    sizes = np.array([len(m[5]) for m in others])
    least = _least(sigs.shape[1])
    sets: dict[int, frozenset] = {}
    found = []
    for id, component, _, _, sig, own in askers:
        alike = (sigs == np.frombuffer(sig, np.uint8)).sum(1)
        near = (alike >= least) & (100 * np.minimum(sizes, len(own)) >= SIMILAR * np.maximum(sizes, len(own)))
        mine = None
        for at in sorted(np.flatnonzero(near), key=lambda x: -alike[x]):
            other, its = others[at][0], top(others[at][1])
            if its == top(component):
                continue
            mine = frozenset(own.tolist()) if mine is None else mine
            if at not in sets:
                sets[at] = frozenset(others[at][5].tolist())
            n = len(mine & sets[at])
            if n * 100 >= (len(mine) + len(sets[at]) - n) * SIMILAR:
                found.append((id, other))
                root[its] = top(component)
    return found


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without ASCII white space, A-Z in lower case; the set holds the distinct shingles of ``k`` words.  Null,
    empty and wordless texts have empty sets and link to nothing.  Rows with equal ids are one document.  A row without id
    links to nothing, has a null component and is kept.
    """
    rows = docs.select(field(docs, id, "id"), field(docs, text, "text"))
    base = settle(sign(rows, k))
    classes = base.where("id is not null and print is not null").groupBy("print").agg(F.min("id").alias("first"))
    leading = classes.select(F.col("first").alias("id")).distinct()
    joined = links(base.where("id is not null and print is not null"), leading, rows, k).toDF("first", "component")
    named = classes.join(joined, "first", "left").select(F.col("print").alias("p"), F.coalesce("component", "first").alias("component"))
    ids = base.where("id is not null").select("id", "print", "n_shingles")
    placed = ids.join(named, ids["print"] == named["p"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    return placed.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    ).union(base.where("id is null").select("id", "n_shingles", F.lit(None).cast(base.schema["id"].dataType), F.lit(True)))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row of each group, that of the smallest id, with all columns; rows without id stay.  Of rows with one id, one."""
    kept = groups(docs, id, text, k).where("kept and doc_id is not null").select("doc_id").distinct()
    rank, named_id = fresh(docs, "_rank", "_id")
    first = F.row_number().over(Window.partitionBy(f"`{id}`").orderBy(F.xxhash64(f"`{text}`")))
    named = docs.where(F.col(f"`{id}`").isNotNull()).join(kept.withColumnRenamed("doc_id", named_id), F.col(f"`{id}`") == F.col(named_id), "left_semi")
    return named.withColumn(rank, first).where(F.col(rank) == 1).drop(rank).union(docs.where(F.col(f"`{id}`").isNull()))
