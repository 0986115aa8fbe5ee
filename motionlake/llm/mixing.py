"""Mixing sources to target weights.

Words are summed per source, sources get targets by weight, and a document is emitted ``floor(rate)`` times plus once
more with probability equal to the fraction, drawn by a seeded hash of its id.  Nothing is collected per source: sums and
targets are small keyed tables, targets come from a few global sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.session import settle

from .common import field, n_words, unit_interval

#: Weights by the sources' position in code point order, repeating; the null source comes last.
WEIGHTS = (5, 2, 1)
#: The mix holds so many per cent of all words, and no source more than REPEAT times its own.
PERCENT = 150
REPEAT = 2
SEED = "mix"


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Words of every source (null is a source): ``source, source_size``.  Hot sources are summed in each task first."""
    return docs.select(field(docs, source, "source"), n_words(docs[f"`{text}`"]).alias("_n")).groupBy("source").agg(
        F.sum("_n").alias("source_size")
    )


def weighted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the sources in code point order, null last, take the weights in turn.

    Positions come from a range-partitioned sort: each range is numbered on its own and shifted by the number of sources
    in the ranges before it, so no task sees all sources.
    """
    ranged = settle(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    )
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range, at most spark.sql.shuffle.partitions rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    place = (F.col("_shift") + F.col("_inside") - 1) % F.lit(len(weights))
    return (
        ranged.withColumn("_inside", inside)
        .join(shifts, "_range")
        .select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeat: int = REPEAT) -> DataFrame:
    """``source, source_size, target`` (double).

    ``percent`` of all words are shared by weight.  A target above ``repeat`` times its source's size stops there and the
    excess is shared again by weight among the others, until none is above.  Each round is one global sum; a round stops
    at least one more source or ends the loop.
    """
    if not 0 < percent <= 100 * repeat:
        raise ValueError("the mix can't hold more than repeat times all words")
    table = settle(weighted(sizes, weights))
    level, stopped = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") > F.col("source_size") * repeat if stopped >= 0 else F.lit(False)
        total, full, free, n = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(capped.cast("long")), F.lit(0)),
        ).first()
        if n == stopped:
            break
        stopped, level = n, (total * percent / 100 - repeat * full) / free if free else level
    return table.select("source", "source_size", _target(level, repeat).alias("target"))


def _target(level: float, repeat: int) -> Column:
    share, most = F.lit(level) * F.col("weight"), (F.col("source_size") * repeat).cast("double")
    return F.when(share > most, most).otherwise(share)


def mix_plan(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, copies, taken``.

    Null text has size 0; a source without words has target 0 and gives no copies.  Documents with equal ids share one draw,
    those without id if their texts are equal.  Reruns draw alike.
    """
    sized = docs.select(field(docs, id, "doc_id"), field(docs, source, "source"), n_words(docs[f"`{text}`"]).alias("size"), _draw(docs, id, text))
    planned = _with_copies(sized, targets(source_sizes(docs, source, text)), seed)
    return planned.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each row as often as its plan says."""
    names = docs.columns
    packed = docs.select(field(docs, id, "doc_id"), field(docs, source, "source"), F.struct(*[f"`{c}`" for c in names]).alias("_row"), _draw(docs, id, text))
    planned = _with_copies(packed, targets(source_sizes(docs, source, text)), seed)
    copies = planned.where("copies > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_i"))
    return copies.select([F.col("_row").getField(c).alias(c) for c in names])


def _draw(docs: DataFrame, id: str, text: str):
    """What a document's draw is made of: its id, or else its text."""
    by_text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    return F.coalesce(F.col(f"`{id}`").cast("string"), by_text).alias("_draw")


def _with_copies(rows: DataFrame, goals: DataFrame, seed: str) -> DataFrame:
    goals = goals.withColumnRenamed("source", "_source")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    extra = unit_interval(seed, F.col("_draw")) < F.col("_rate") - F.floor("_rate")
    return (
        rows.join(goals, rows["source"].eqNullSafe(goals["_source"]))
        .withColumn("_rate", rate)
        .withColumn("copies", (F.floor("_rate") + extra.cast("long")).cast("long"))
    )
