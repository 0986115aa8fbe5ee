"""Sprint sessions of one athlete on one date, and progression between them.

Row-sized data is reduced to one row per (client, session_date) first.  Windows run only on that reduced
table, where a client has at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import cv_percent, percent
from ..functions.samples import cohen_d, t_test_p

SESSION = ["client", "session_date"]
# session metric -> True when smaller is better
PROGRESS_METRICS = {"max_speed": False, "best_split": True, "max_acceleration": False}


def known_clients(sprints: DataFrame) -> DataFrame:
    return sprints.where(F.col("client").isNotNull())


def session_stats(sprints: DataFrame) -> DataFrame:
    """Speed, split and acceleration statistics per client and date.

    ``n_speeds`` and ``speed_var`` (sample variance) are all that later tests need, so no value lists are kept.
    """
    speed = F.col("top_speed")
    return (
        known_clients(sprints)
        .groupBy(*SESSION)
        .agg(
            F.max(speed).alias("max_speed"),
            F.avg(speed).alias("avg_speed"),
            F.min("split_5").alias("best_split"),
            F.avg("split_5").alias("avg_split"),
            F.max("max_accel").alias("max_acceleration"),
            cv_percent(F.stddev_samp(speed), F.avg(speed)).alias("consistency"),
            F.count(F.lit(1)).alias("sprints"),
            F.count(speed).alias("n_speeds"),
            F.var_samp(speed).alias("speed_var"),
        )
    )


def athlete_summary(sprints: DataFrame) -> DataFrame:
    speed = F.col("top_speed")
    return (
        known_clients(sprints)
        .groupBy("client")
        .agg(
            F.max(speed).alias("max_speed"),
            F.avg(speed).alias("avg_speed"),
            F.min("split_5").alias("best_split"),
            cv_percent(F.stddev_samp(speed), F.avg(speed)).alias("consistency"),
            F.countDistinct("session_date").alias("sessions"),
        )
    )


def session_progress(sprints: DataFrame) -> DataFrame:
    return (
        known_clients(sprints)
        .groupBy(*SESSION)
        .agg(
            F.max("top_speed").alias("max_speed"),
            F.min("split_5").alias("best_split"),
            F.max("max_accel").alias("max_acceleration"),
        )
    )


def _progress_long(sprints: DataFrame) -> DataFrame:
    return session_progress(sprints).unpivot(SESSION, list(PROGRESS_METRICS), "metric", "value")


def session_trend_lines(sprints: DataFrame) -> DataFrame:
    """Line fitted to the non-null session values, squeezed onto 0..m-1, read at every session's index."""
    whole = W.partitionBy("client", "metric")
    by_date = whole.orderBy("session_date")
    return (
        _progress_long(sprints)
        .withColumns(
            {
                "session_index": F.row_number().over(by_date) - 1,
                "_x": F.when(F.col("value").isNotNull(), F.count("value").over(by_date) - 1),
            }
        )
        .withColumns(
            {
                "_points": F.count("value").over(whole),
                "_slope": F.regr_slope("value", "_x").over(whole),
                "_start": F.regr_intercept("value", "_x").over(whole),
            }
        )
        .withColumn(
            "trend", F.when(F.col("_points") >= 2, F.col("_start") + F.col("_slope") * F.col("session_index"))
        )
        .drop("_x", "_points", "_slope", "_start")
    )


def first_to_latest_change(sprints: DataFrame) -> DataFrame:
    """Percent change from first to latest session; positive means better for every metric."""
    ends = (
        _progress_long(sprints)
        .groupBy("client", "metric")
        .agg(
            F.min_by("value", "session_date").alias("first_value"),
            F.max_by("value", "session_date").alias("latest_value"),
            F.count(F.lit(1)).alias("sessions"),
        )
        .where("sessions >= 2")
    )
    lower_is_better = F.col("metric").isin([m for m, inverted in PROGRESS_METRICS.items() if inverted])
    change = percent(F.col("latest_value") - F.col("first_value"), F.col("first_value"))
    return ends.withColumn("change_pct", F.when(lower_is_better, -change).otherwise(change))


def baseline_progression(sprints: DataFrame) -> DataFrame:
    """Every later session against the client's first one."""
    per_client = W.partitionBy("client")
    first = {
        f"_{name}": F.min_by(name, "session_date").over(per_client)
        for name in ("max_speed", "avg_speed", "n_speeds", "speed_var")
    }
    sample_pair = [
        F.col(name)
        for name in ("_n_speeds", "_avg_speed", "_speed_var", "n_speeds", "avg_speed", "speed_var")
    ]
    gain = F.col("max_speed") - F.col("_max_speed")
    return (
        session_stats(sprints)
        .withColumns(first | {"baseline_date": F.min("session_date").over(per_client)})
        .where("session_date > baseline_date")
        .select(
            *SESSION,
            "baseline_date",
            F.datediff("session_date", "baseline_date").alias("days"),
            "max_speed",
            gain.alias("change"),
            percent(gain, F.col("_max_speed")).alias("change_pct"),
            t_test_p(*sample_pair).alias("p_value"),
            cohen_d(*sample_pair).alias("effect_size"),
            (gain > 0).alias("improved"),
        )
    )


def progress_band(share, excellent: str, good: str, rest: str):
    return F.when(share >= 0.75, excellent).when(share >= 0.5, good).otherwise(rest)


def progression_summary(progression: DataFrame) -> DataFrame:
    """One row per client over :func:`baseline_progression`."""
    summary = progression.groupBy("client").agg(
        F.count_if("improved").alias("improved_sessions"),
        F.count(F.lit(1)).alias("later_sessions"),
        F.avg("change_pct").alias("avg_change_pct"),
        F.max_by("max_speed", "session_date").alias("latest_speed"),
        F.max_by("change", "session_date").alias("total_gain"),
    )
    share = F.col("improved_sessions") / F.col("later_sessions")
    return summary.withColumn("verdict", progress_band(share, "Excellent", "Positive", "Review Needed"))


def velocity_decrement(sprints: DataFrame) -> DataFrame:
    """Add ``velocity_decrement``: percent below the best same-day speed at the client's lightest load.

    The best speeds come from one (client, date, load) aggregate, reduced to one row per day before the client's
    lightest load is known, and are joined back on (client, date).  Spark broadcasts them when small and splits
    skewed partitions otherwise; a window over a client's rows could do neither.
    """
    by_load = (
        known_clients(sprints)
        .where(F.col("load").isNotNull())
        .groupBy(*SESSION, "load")
        .agg(F.max("top_speed").alias("_best"))
    )
    unloaded = (
        by_load.groupBy(*SESSION)
        .agg(F.min("load").alias("_load"), F.min_by("_best", "load").alias("_best"))
        .withColumn("_lightest", F.min("_load").over(W.partitionBy("client")))
        .where(F.col("_load") == F.col("_lightest"))
        .select(*SESSION, "_best")
    )
    gap = percent(F.col("_best") - F.col("top_speed"), F.col("_best"))
    return sprints.join(unloaded, SESSION, "left").withColumn("velocity_decrement", gap).drop("_best")
