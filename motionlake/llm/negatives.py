"""Hard negatives by slot-decomposed selection.

Each anchor has a few positives: the best-scoring other rows of its label.  For each positive the best rows of other labels
are wanted whose score lies between a share of the positive's score and that score.  These windows overlap, but their upper
limits cut the scores into disjoint slots: a window is its own slot and all lower ones, down to its lower limit.  So one pass
keeps the best few of each slot, in every task and again after the shuffle, and a merge from the lowest slot upwards answers
all windows.

Anchors and rows meet in blocks: rows and anchors are dealt to blocks of bounded size, and one task holds one block of each.
A task returns a bounded number of rows per anchor, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motionlake.session import settle

#: Rows, and anchors, that one task holds.
BLOCK = 4096
#: Scores that one task holds at a time.
CELLS = 1 << 20

POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this share of the positive (per cent).
FLOOR = 80
SCALE = 256

_LONG = np.iinfo(np.int64)


def whole_numbers(vectors: pa.Array, scale: int) -> np.ndarray:
    """Vectors as rows of whole numbers ``floor(scale * x)`` in doubles; shorter ones end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * scale)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers as 64-bit integers; what passes 64 bits stays at their limit."""
    width = min(x.shape[1], y.shape[1])
    x, y = x[:, :width], y[:, :width]
    most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(width, 1)
    if most < 2.0**53:  # every sum is exact in doubles
        return (x @ y.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) @ np.array([[int(v) for v in row] for row in y], object).reshape(y.shape).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by score, highest first, then by id."""
    order = np.lexsort((ids, ~score, group))  # ~score falls as the score rises and has no overflow
    own = group[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return order[place < k]


def eligible(rows: DataFrame, id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """``id, label, vector`` of the rows that take part: with id and label, and all components and their multiples finite."""
    # not (x < infinity) holds for NaN too, which sorts above infinity
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    return rows.select(id.alias("id"), label.alias("label"), vector.alias("vector")).where("id is not null and label is not null and vector is not null").where(finite)


def _blocks(rows: int, block: int) -> int:
    return max(1, -(-rows // block))


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, block: int):
    """Anchors and rows grouped by (i, j): each block of rows meets each block of anchors once."""
    a, r = _blocks(n_anchors, block), _blocks(n_rows, block)
    # settled tables keep their order, so these numbers deal rows evenly and alike on every attempt
    number = F.monotonically_increasing_id()
    left = anchors.withColumn("j", F.pmod(F.xxhash64(number), F.lit(a)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    right = rows.withColumn("i", F.pmod(F.xxhash64(number), F.lit(r)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def _tiles(n_anchors: int, n_rows: int) -> list[tuple[slice, slice]]:
    """Parts of a block's score table with at most ``CELLS`` cells."""
    wide = min(max(n_rows, 1), 4096)
    tall = max(1, CELLS // wide)
    return [(slice(i, i + tall), slice(j, j + wide)) for i in range(0, n_anchors, tall) for j in range(0, n_rows, wide)]


def _batch(columns: dict[str, list[np.ndarray]], kinds: list[str]) -> pa.Table:
    types = {"long": (pa.int64(), np.int64), "int": (pa.int32(), np.int32)}
    return pa.table({
        name: pa.array(np.concatenate(parts) if parts else np.zeros(0, types[kind][1]), types[kind][0])
        for (name, parts), kind in zip(columns.items(), kinds, strict=True)
    })


def positives(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int = POSITIVES, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """``anchor, id, score, place``: the first ``k`` rows of the anchor's label with another id."""

    def meet(these: pa.Table, those: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"anchor": [], "id": [], "score": []}
        x, y = whole_numbers(these["vector"].combine_chunks(), scale), whole_numbers(those["vector"].combine_chunks(), scale)
        anchor, own, own_label = (these[c].to_numpy() for c in ("anchor", "id", "label"))
        ids, label = those["id"].to_numpy(), those["label"].to_numpy()
        for kind in np.intersect1d(own_label, label):
            at, of = np.flatnonzero(own_label == kind), np.flatnonzero(label == kind)
            for some, part in _tiles(len(at), len(of)):
                a, b = at[some], of[part]
                score = inner_products(x[a], y[b])
                row, column = np.nonzero(own[a][:, None] != ids[b])
                if len(b) > k:  # only what reaches the k-th score (own id aside) can be among the first
                    least = np.partition(score, len(b) - k - 1, axis=1)[:, len(b) - k - 1]
                    high = score[row, column] >= least[row]
                    row, column = row[high], column[high]
                found = best(row, score[row, column], ids[b][column], k)
                row, column = row[found], column[found]
                for name, values in (("anchor", anchor[a][row]), ("id", ids[b][column]), ("score", score[row, column])):
                    out[name].append(values)
        return _batch(out, ["long"] * 3)

    met = _grid(anchors, rows, n_anchors, n_rows, block).applyInArrow(meet, "anchor long, id long, score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def floors(score: Column, floor: int) -> Column:
    """Least whole number n with 100 n >= floor * score, for scores of 0 and more; the product may pass 64 bits."""
    return F.ceil(score.cast("decimal(20,0)") * floor / 100).cast("long")


def slotted(found: DataFrame, floor: int = FLOOR) -> DataFrame:
    """``anchor, uppers, least``: the slots' upper limits, highest first, and the lowest score that any window holds.

    A positive with a negative score has no window: the share of it is above it.
    """
    usable = found.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("uppers"))
    return usable.withColumn("least", floors(F.array_min("uppers"), floor))


def slot_candidates(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int = NEGATIVES, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """``anchor, slot, id, score``: of each slot the first ``k`` rows of other labels; ``anchors`` carry their slots."""

    def meet(these: pa.Table, those: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"anchor": [], "slot": [], "id": [], "score": []}
        x, y = whole_numbers(these["vector"].combine_chunks(), scale), whole_numbers(those["vector"].combine_chunks(), scale)
        anchor, own_label, least = (these[c].to_numpy() for c in ("anchor", "label", "least"))
        ids, label = those["id"].to_numpy(), those["label"].to_numpy()
        limits = these["uppers"].combine_chunks()
        lengths = limits.value_lengths().to_numpy()
        uppers = np.full((len(anchor), int(lengths.max(initial=0))), _LONG.min)
        uppers[np.arange(uppers.shape[1]) < lengths[:, None]] = limits.flatten().to_numpy()
        for a, b in _tiles(len(anchor), len(ids)):
            score = inner_products(x[a], y[b])
            row, column = np.nonzero((score >= least[a][:, None]) & (score <= uppers[a, :1]) & (own_label[a][:, None] != label[b]))
            value = score[row, column]
            # a score's slot is the last one with an upper limit not below it
            slot = (uppers[a][row] >= value[:, None]).sum(axis=1) - 1
            found = best(row * uppers.shape[1] + slot, value, ids[b][column], k)
            for name, values in (("anchor", anchor[a][row[found]]), ("slot", slot[found]), ("id", ids[b][column[found]]), ("score", value[found])):
                out[name].append(values)
        return _batch(out, ["long", "int", "long", "long"])

    met = _grid(anchors, rows, n_anchors, n_rows, block).applyInArrow(meet, "anchor long, slot int, id long, score long")
    place = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def suffixes(candidates: DataFrame, slots: int, k: int = NEGATIVES) -> DataFrame:
    """``anchor, firsts``: for each slot the first ``k`` candidates of it and all lower slots, by a merge from the lowest."""
    entry = F.struct((-F.col("score")).alias("lower"), "id", "score")
    of_slot = candidates.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(entry)).alias("best"))
    by_anchor = of_slot.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))
    none = F.array().cast(candidates.select(F.array(entry)).schema[0].dataType)
    empty = F.array().cast(candidates.select(F.array(F.array(entry))).schema[0].dataType)
    # what a slot keeps scores higher than what lower slots keep, so a merge is an append
    merged = F.aggregate(
        F.sequence(F.lit(slots - 1), F.lit(0)), empty,
        lambda done, slot: F.array_append(done, F.slice(F.concat(F.coalesce(F.try_element_at("slots", slot), none), F.coalesce(F.get(done, F.size(done) - 1), none)), 1, k)),
        F.reverse,
    )
    return by_anchor.select("anchor", merged.alias("firsts"))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id: str = "id", label: str = "label", vector: str = "vector", n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES, floor: int = FLOOR, scale: int = SCALE, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, ranks from 1 for each positive.

    ``is_anchor`` is a condition over ``id``.  Scores are inner products of ``floor(scale * x)``, exact; products
    past 64 bits count as the largest number of 64 bits.  Higher scores come first, ties by smaller id.  An anchor's positives
    are the first ``n_positives`` rows of its label with another id; a positive's negatives the first ``n_negatives`` rows of
    another label with ``floor / 100 * positive <= negative <= positive``.

    Rows without id, label or vector, or with a component that is null or not finite (also once scaled), take no part.
    A vector of fewer components than another counts as ending in zeros.  Equal anchor rows are one anchor; other repeated
    rows are rows of their own.  Empty tables give no rows; columns besides the named three are not read.
    """
    whole = settle(eligible(rows, F.col(f"`{id}`").cast("long"), F.col(f"`{label}`").cast("long"), F.col(f"`{vector}`"), scale))
    n_rows = whole.count()
    chosen = whole.where(F.coalesce(is_anchor, F.lit(False))).dropDuplicates()
    anchors = settle(chosen.withColumn("anchor", F.monotonically_increasing_id()))
    n_anchors = anchors.count()
    found = settle(positives(anchors, whole, n_anchors, n_rows, n_positives, scale, block))
    ready = settle(anchors.join(slotted(found, floor), "anchor"))
    candidates = slot_candidates(ready, whole, ready.count(), n_rows, n_negatives, scale, block)
    answers = suffixes(candidates, n_positives, n_negatives)
    windows = found.where("score >= 0").withColumn("slot", F.dense_rank().over(W.partitionBy("anchor").orderBy(F.desc("score"))) - 1)
    inside = F.filter(F.get("firsts", F.col("slot")), lambda n: n["score"] >= floors(F.col("score"), floor))
    named = windows.join(answers, "anchor").join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    each = named.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(inside).alias("_at", "_n"))
    return each.select(
        "anchor_id", "positive_id", (F.col("_at") + 1).alias("rank"), F.col("_n.id").alias("negative_id"), "positive_score", F.col("_n.score").alias("negative_score")
    )
