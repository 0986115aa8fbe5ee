"""Entity profiles against the group, and head-to-head comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import half_even, percent
from ..functions.tails import normal_cdf
from .selection import members


def entity_means(measures: DataFrame) -> DataFrame:
    return (
        measures.where("entity is not null and metric is not null")
        .groupBy("entity", "metric")
        .agg(F.avg("value").alias("value"))
    )


def entity_profiles(measures: DataFrame, group: Sequence | DataFrame | None = None) -> DataFrame:
    """Mean of every entity and metric as z-score and normal percentile against the group's raw values.

    The group statistics are one row per metric; Spark broadcasts them when they are small.
    """
    base = measures if group is None else members(measures, "entity", group)
    stats = (
        base.where("entity is not null and metric is not null")
        .groupBy("metric")
        .agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    )
    z = F.when(F.col("_std") > 0, F.try_divide(F.col("value") - F.col("_mean"), F.col("_std"))).otherwise(F.lit(0.0))
    return (
        entity_means(measures)
        .join(stats, "metric")
        .withColumn("_z", z)
        .select(
            "entity",
            "metric",
            half_even(F.col("value"), 2).alias("value"),
            half_even(F.col("_mean"), 2).alias("group_avg"),
            half_even(F.col("_z"), 2).alias("z_score"),
            half_even(normal_cdf(F.col("_z")) * 100.0, 1).alias("percentile"),
        )
    )


def strengths_and_weaknesses(profiles: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest and ``n`` lowest z-scores per entity; an entity has one row per metric."""
    per_entity = W.partitionBy("entity")
    high = F.row_number().over(per_entity.orderBy(F.desc_nulls_last("z_score"), "metric"))
    count = F.count(F.lit(1)).over(per_entity)
    ranked = profiles.withColumns({"_rank": high, "_count": count})
    sides = F.array_compact(
        F.array(
            F.when(F.col("_rank") <= n, F.lit("strength")),
            F.when(F.col("_rank") > F.col("_count") - n, F.lit("weakness")),
        )
    )
    return ranked.select("entity", "metric", "z_score", F.col("_rank").alias("rank"), F.explode(sides).alias("kind"))


def profile_summary(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("entity").agg(
        F.count(F.lit(1)).alias("metrics"),
        F.avg("percentile").alias("avg_percentile"),
        F.count_if(F.col("z_score") > 0).alias("above_average"),
    )


def head_to_head(measures: DataFrame, pairs: DataFrame) -> DataFrame:
    """Means of both entities of every pair (``first``, ``second``) on the metrics both have.

    Only the (entity, metric) means are joined.
    """
    means = entity_means(measures)
    left = means.select(F.col("entity").alias("first"), "metric", F.col("value").alias("_a"))
    right = means.select(F.col("entity").alias("second"), "metric", F.col("value").alias("_b"))
    gap = F.col("_a") - F.col("_b")
    gap_pct = F.when(F.col("_b") == 0, F.lit(0.0)).otherwise(percent(gap, F.abs("_b")))
    return (
        pairs.join(left, "first")
        .join(right, ["second", "metric"])
        .select(
            "first",
            "second",
            "metric",
            half_even(F.col("_a"), 2).alias("first_value"),
            half_even(F.col("_b"), 2).alias("second_value"),
            half_even(gap, 2).alias("difference"),
            half_even(gap_pct, 1).alias("difference_pct"),
            F.when(gap > 0, F.col("first")).otherwise(F.col("second")).alias("winner"),
        )
    )


def radar_values(comparison: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` metrics of every pair scaled to 20..100 within the pair, 60 for equal values."""
    rank = F.row_number().over(W.partitionBy("first", "second").orderBy("metric"))
    a, b = F.col("first_value"), F.col("second_value")
    return (
        comparison.withColumn("_rank", rank)
        .where(F.col("_rank") <= n)
        .select(
            "first",
            "second",
            "metric",
            F.when(a > b, 100.0).when(a < b, 20.0).otherwise(60.0).alias("first_radar"),
            F.when(b > a, 100.0).when(b < a, 20.0).otherwise(60.0).alias("second_radar"),
        )
    )


def win_tally(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("first", "second").agg(
        F.count_if(F.col("winner") == F.col("first")).alias("first_wins"),
        F.count_if(F.col("winner") == F.col("second")).alias("second_wins"),
        F.avg(F.abs("difference_pct")).alias("avg_difference_pct"),
    )


def run_summary(measures: DataFrame, available: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Entities, usable metrics, rows, year span and, when assignments are given, clusters."""
    year = F.year("test_ts")
    found = clusters.agg(F.countDistinct("cluster")).scalar() if clusters is not None else F.lit(None).cast("bigint")
    return (
        measures.groupBy("entity")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(year).alias("low"), F.max(year).alias("high"))
        .agg(
            F.count("entity").alias("entities"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.concat_ws("-", F.min("low"), F.max("high")).alias("period"),
        )
        .withColumns({"metrics": available.agg(F.count(F.lit(1))).scalar(), "clusters": found})
    )
