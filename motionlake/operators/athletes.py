"""Single-athlete reports computed for all athletes: dominance, endurance, risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import band, percent
from ..functions.samples import merged, merged_mean, merged_variance, moment_columns
from .asymmetry import side_gap, side_risk
from .sessions import SESSION, known_clients

# fixed texts of the risk report
RECOMMENDATIONS = {
    "High": "Reduce training load, focus on corrective exercises",
    "Moderate": "Monitor closely, consider lighter loads",
    "Low": "Continue current training program",
}


def acceleration_dominance(sprints: DataFrame) -> DataFrame:
    ratio = F.col("ratio")
    profile = (
        F.when(ratio > 8.5, "Top Speed Dominant")
        .when(ratio < 7.0, "Acceleration Dominant")
        .otherwise("Balanced")
    )
    speed_share = F.when(ratio > 8.5, 60).when(ratio < 7.0, 40).otherwise(50)
    return (
        known_clients(sprints)
        .groupBy("client")
        .agg(F.min("split_5").alias("best_split"), F.max("top_speed").alias("max_speed"))
        .withColumn("ratio", F.try_divide(F.col("max_speed"), F.col("best_split")))
        .withColumns({"profile": profile, "speed_contribution": speed_share})
        .withColumn("accel_contribution", 100 - F.col("speed_contribution"))
    )


def eccentric_capacity(sprints: DataFrame, min_rows: int = 5) -> DataFrame:
    """Eccentric against concentric load; athletes with at least ``min_rows`` eccentric values."""
    ratio = F.col("ratio")
    capacity = (
        F.when(ratio > 1.4, "Excellent")
        .when(ratio > 1.2, "Good")
        .when(ratio >= 1.0, "Developing")
        .otherwise("Needs Development")
    )
    return (
        known_clients(sprints)
        .groupBy("client")
        .agg(
            F.count("ecc_load").alias("rows_with_eccentric"),
            F.avg("load").alias("avg_concentric"),
            F.avg("ecc_load").alias("avg_eccentric"),
            F.max("ecc_load").alias("max_eccentric"),
            F.max("load").alias("max_concentric"),
        )
        .where(F.col("rows_with_eccentric") >= min_rows)
        .withColumn(
            "ratio",
            F.when(
                F.col("avg_concentric") > 0, F.try_divide(F.col("avg_eccentric"), F.col("avg_concentric"))
            ).otherwise(F.lit(0.0)),
        )
        .withColumn("capacity", capacity)
    )


def power_endurance(sprints: DataFrame, rep_order: Sequence[str] = ("rep_ts",)) -> DataFrame:
    """Mean speed of the first three against the last three reps of every session with six or more.

    Both ends are ``row_number() <= 3`` filters, which Spark also applies before the shuffle: a session that
    owns a large share of all rows sends at most three rows per task.  Equal reps are ordered by speed.
    """
    reps = known_clients(sprints).select(*SESSION, *rep_order, "top_speed")
    order = [*rep_order, "top_speed"]

    def end(name: str, direction) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*SESSION).orderBy(*[direction(c) for c in order]))
        return (
            reps.withColumn("_k", rank)
            .where("_k <= 3")
            .select(*SESSION, F.lit(name).alias("_end"), "top_speed", F.lit(None).cast("bigint").alias("_n"))
        )

    counts = (
        reps.groupBy(*SESSION)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*SESSION, F.lit(None).cast("string").alias("_end"), F.lit(None).cast("double").alias("top_speed"), "_n")
    )

    def mean_of(name: str) -> Column:
        return F.avg(F.when(F.col("_end") == name, F.col("top_speed")))

    decrement = F.col("decrement")
    return (
        end("first", F.asc_nulls_last)
        .unionByName(end("last", F.desc_nulls_first))
        .unionByName(counts)
        .groupBy(*SESSION)
        .agg(
            F.max("_n").alias("reps"),
            mean_of("first").alias("first_avg"),
            mean_of("last").alias("last_avg"),
        )
        .where("reps >= 6")
        .withColumn("decrement", percent(F.col("first_avg") - F.col("last_avg"), F.col("first_avg")))
        .withColumn("endurance", band(decrement, [(3, "Excellent"), (5, "Good"), (8, "Moderate")], "Poor"))
    )


def injury_risk(sprints: DataFrame) -> DataFrame:
    """Risk score from side asymmetry, recent speed drop and variability.

    Everything derives from one (client, date, side) aggregate of the rows: one scan, and windows over the days of
    a client only.
    """
    per_client = W.partitionBy("client")
    back = F.dense_rank().over(per_client.orderBy(F.desc("session_date")))

    def best(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("best")))

    overall = (
        known_clients(sprints)
        .groupBy(*SESSION, "side")
        .agg(F.max("top_speed").alias("best"), *moment_columns("top_speed", "speed"))
        .withColumns(merged("speed", per_client) | {"_back": back})
        .groupBy("client")
        .agg(
            best(F.col("side") == "Left").alias("left_speed"),
            best(F.col("side") == "Right").alias("right_speed"),
            best(F.col("_back") <= 3).alias("recent"),
            best(F.col("_back").between(4, 6)).alias("before"),
            F.max("_back").alias("dates"),
            percent(F.sqrt(merged_variance("speed")), merged_mean("speed")).alias("speed_cv"),
        )
        .withColumn(
            "speed_drop",
            F.when(F.col("dates") >= 6, percent(F.col("before") - F.col("recent"), F.col("before"))),
        )
    )
    gap, drop, cv = F.col("speed_asymmetry"), F.col("speed_drop"), F.col("speed_cv")
    level = side_risk(gap)
    score = (
        F.when(level == "High", 35).when(level == "Moderate", 20).otherwise(0)
        + F.when(drop > 5, 35).otherwise(0)
        + F.when(cv > 10, 30).otherwise(0)
    )
    factors = F.array_compact(
        F.array(
            F.when(level.isin("High", "Moderate"), F.format_string("%s asymmetry: %.1f%%", level, gap)),
            F.when(drop > 5, F.format_string("Recent speed drop: %.1f%%", drop)),
            F.when(cv > 10, F.format_string("High variability: %.1f%% CV", cv)),
        )
    )
    risk = F.when(F.col("risk_score") >= 50, "High").when(F.col("risk_score") >= 25, "Moderate").otherwise("Low")
    advice = F.when(F.col("risk_level") == "High", RECOMMENDATIONS["High"]).when(
        F.col("risk_level") == "Moderate", RECOMMENDATIONS["Moderate"]
    )
    return (
        overall.withColumn("speed_asymmetry", side_gap(F.col("left_speed"), F.col("right_speed")))
        .withColumns({"risk_score": score, "risk_factors": factors})
        .withColumn("risk_level", risk)
        .withColumn("recommendation", advice.otherwise(RECOMMENDATIONS["Low"]))
        .select("client", "risk_score", "risk_level", "risk_factors", "recommendation", "speed_asymmetry", "speed_drop", "speed_cv")
    )
