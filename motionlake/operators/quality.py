"""Data quality of the long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even, percent

STRICT_COMPLETENESS = 50
STRICT_ENTITIES = 2
STRICT_METRICS = 5


def load_summary(measures: DataFrame) -> DataFrame:
    """Rows, distinct entities, metrics and days, first and last date.

    One pass over the rows with three grouping sets: partial aggregates leave one row per entity, metric and day,
    so nothing row-sized is shuffled.
    """
    keys = measures.select("entity", "metric", F.to_date("test_ts").alias("day"))
    groups = keys.groupingSets([["entity"], ["metric"], ["day"]], "entity", "metric", "day").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_rows")
    )
    # grouping_id has a bit for every key left out of the set

    def of(bits: int, column: str):
        return F.when(F.col("_set") == bits, F.col(column))

    entity, metric, day = 0b011, 0b101, 0b110
    return groups.agg(
        F.coalesce(F.sum(of(entity, "_rows")), F.lit(0)).alias("rows"),
        F.count(of(entity, "entity")).alias("entities"),
        F.count(of(metric, "metric")).alias("metrics"),
        F.min(of(day, "day")).alias("first_date"),
        F.max(of(day, "day")).alias("last_date"),
        F.count(of(day, "day")).alias("training_days"),
    )


def metric_profile(measures: DataFrame) -> DataFrame:
    """Statistics per metric.

    ``completeness_pct`` relates the values to the non-null count (100, or NULL without values), as the quality
    gate expects; ``row_completeness_pct`` relates them to all rows.
    """
    std, mean = F.stddev_samp("value"), F.avg("value")
    return (
        measures.where("metric is not null")
        .groupBy("metric")
        .agg(
            mean.alias("mean"),
            std.alias("std"),
            F.count("value").alias("datapoints"),
            F.countDistinct("entity").alias("entities"),
            percent(F.count("value"), F.count("value")).alias("completeness_pct"),
            percent(F.count("value"), F.count(F.lit(1))).alias("row_completeness_pct"),
        )
        .withColumn("cv", F.coalesce(F.try_divide(F.col("std"), F.col("mean")), F.lit(0.0)))
    )


def available_metrics(profile: DataFrame) -> DataFrame:
    """Metrics fit for analysis: the strict gate, or any metric with data when fewer than five pass it."""
    strict = (F.col("completeness_pct") >= STRICT_COMPLETENESS) & (F.col("entities") >= STRICT_ENTITIES)
    passing = profile.agg(F.count_if(strict)).scalar()
    relaxed = (F.col("datapoints") >= 1) & (F.col("entities") >= 1)
    return profile.where(F.when(passing >= STRICT_METRICS, strict).otherwise(relaxed))


def top_metrics(profile: DataFrame, n: int = 10) -> DataFrame:
    return (
        profile.select("metric", "completeness_pct", "entities")
        .orderBy(F.desc_nulls_last("completeness_pct"), "metric")
        .limit(n)
    )


def completeness(measures: DataFrame) -> DataFrame:
    """Non-null values per entity and metric, in long form for any number of metrics."""
    return (
        measures.where("entity is not null and metric is not null")
        .groupBy("entity", "metric")
        .agg(F.count("value").alias("datapoints"), F.count(F.lit(1)).alias("rows"))
    )


def completeness_matrix(measures: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Entity by metric counts for a given list of metrics, 0 where nothing was measured."""
    return (
        measures.where("entity is not null")
        .groupBy("entity")
        .pivot("metric", list(metrics))
        .agg(F.count("value"))
        .fillna(0)
    )


def coverage_scores(measures: DataFrame, metrics: DataFrame) -> DataFrame:
    """Share of the listed metrics each entity has.

    The numerator counts all metrics of the entity, so the score can exceed 100.
    """
    listed = metrics.agg(F.count(F.lit(1))).scalar().cast("double")
    return (
        completeness(measures)
        .groupBy("entity")
        .agg(
            F.count(F.lit(1)).alias("metrics_with_data"),
            F.sum("rows").alias("total_points"),
        )
        .withColumns(
            {
                "coverage_pct": half_even(percent(F.col("metrics_with_data"), listed), 1),
                "avg_points_per_metric": half_even(F.col("total_points") / F.col("metrics_with_data"), 1),
            }
        )
    )


def coverage_rollup(scores: DataFrame, available: DataFrame) -> DataFrame:
    listed = available.agg(F.count(F.lit(1))).scalar().cast("double")
    return scores.agg(
        F.avg("coverage_pct").alias("avg_coverage"),
        F.max("coverage_pct").alias("best_coverage"),
        F.min("coverage_pct").alias("lowest_coverage"),
        F.sum("total_points").alias("total_points"),
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("coverage_pct") < 50).alias("low_coverage_entities"),
    ).withColumn("overall_completeness", percent(F.col("total_points"), F.col("entities") * listed))
