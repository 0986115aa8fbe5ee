"""Team comparison between a baseline and a recent date range."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import percent
from ..functions.samples import cohen_d, t_test_p
from .sessions import known_clients, progress_band


def _check_ranges(baseline: tuple[date, date], recent: tuple[date, date]) -> None:
    if baseline[0] >= baseline[1]:
        raise ValueError("the baseline range must start before it ends")
    if recent[0] >= recent[1]:
        raise ValueError("the recent range must start before it ends")
    if baseline[1] >= recent[0]:
        raise ValueError("the baseline range must end before the recent range starts")


def team_periods(sprints: DataFrame, baseline: tuple[date, date], recent: tuple[date, date]) -> DataFrame:
    """Per client with rows in both inclusive ranges: maxima, change, t-test and effect size.

    One scan and one shuffle of partial aggregates: both periods are conditional aggregates of one group.
    ``*_sprints`` count rows, ``*_dates`` distinct session dates.
    """
    _check_ranges(baseline, recent)
    day = F.col("session_date")
    inside = {
        "baseline": day.between(F.lit(baseline[0]), F.lit(baseline[1])),
        "recent": day.between(F.lit(recent[0]), F.lit(recent[1])),
    }
    speed = F.col("top_speed")
    # reduce to one row per (client, date) first, so counting dates needs no second shuffle of rows
    daily = (
        known_clients(sprints)
        .where(inside["baseline"] | inside["recent"])
        .groupBy("client", F.when(inside["baseline"], "baseline").otherwise("recent").alias("period"), "session_date")
        .agg(
            F.count(F.lit(1)).alias("sprints"),
            F.max(speed).alias("best"),
            F.avg(speed).alias("mean"),
            (F.var_pop(speed) * F.count(speed)).alias("m2"),
            F.count(speed).alias("n"),
        )
    )
    per_client = W.partitionBy("client")

    def of(period: str, col):
        return F.when(F.col("period") == period, col)

    # mean of each period, then squares about it, so that merging the days loses no digits
    grand = F.coalesce(
        *[
            of(p, F.try_divide(F.sum(of(p, F.col("n") * F.col("mean"))).over(per_client), F.sum(of(p, F.col("n"))).over(per_client)))
            for p in inside
        ]
    )
    merged = daily.withColumn("grand", grand)
    squares = F.col("m2") + F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))

    columns = []
    for p in inside:
        columns += [
            F.coalesce(F.sum(of(p, F.col("sprints"))), F.lit(0)).alias(f"{p}_sprints"),
            F.count(of(p, F.col("session_date"))).alias(f"{p}_dates"),
            F.max(of(p, F.col("best"))).alias(f"{p}_max"),
            F.max(of(p, F.col("grand"))).alias(f"{p}_mean"),
            F.sum(of(p, F.col("n"))).alias(f"_{p}_n"),
            F.sum(of(p, squares)).alias(f"_{p}_m2"),
        ]
    compared = merged.groupBy("client").agg(*columns).where("baseline_sprints > 0 and recent_sprints > 0")

    pair = []
    for p in inside:
        n = F.col(f"_{p}_n")
        pair += [n, F.col(f"{p}_mean"), F.when(n > 1, F.try_divide(F.col(f"_{p}_m2"), n - 1))]
    change = F.col("recent_max") - F.col("baseline_max")
    return compared.select(
        "client",
        "baseline_sprints",
        "recent_sprints",
        "baseline_dates",
        "recent_dates",
        "baseline_max",
        "recent_max",
        change.alias("speed_change"),
        percent(change, F.col("baseline_max")).alias("speed_change_pct"),
        t_test_p(*pair).alias("p_value"),
        cohen_d(*pair).alias("effect_size"),
        (change > 0).alias("improved"),
    )


def team_summary(periods: DataFrame) -> DataFrame:
    """One row over :func:`team_periods`; no row when no client has both periods."""
    totals = periods.agg(
        F.count(F.lit(1)).alias("athletes"),
        F.count_if("improved").alias("improved"),
        F.count_if(F.col("p_value") < 0.05).alias("significant"),
        F.avg("baseline_max").alias("avg_baseline_max"),
        F.avg("recent_max").alias("avg_recent_max"),
    ).where("athletes > 0")
    share = F.col("improved") / F.col("athletes")
    return totals.withColumns(
        {
            "improvement_rate": share * 100.0,
            "verdict": progress_band(share, "Excellent", "Good", "Review"),
        }
    )
