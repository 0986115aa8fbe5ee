"""Order statistics that hold when one group owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def with_position(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Add ``pos`` (0-based rank by ``ts`` inside ``keys``), ``n_points`` and ``n_values`` (points with a value).

    A DATE column allows at most one row per calendar day and group, so a plain window is bounded.  With
    timestamps it would sort a hot group in one task: rows are then ranked inside (keys, hour) and shifted by the
    number of earlier rows, taken from the per-hour counts.  Both branches need the same columns of ``df``, so
    Spark runs an aggregate below once and reuses its exchange.
    """
    keys = list(keys)
    if isinstance(df.schema[ts].dataType, DateType):
        group = W.partitionBy(*keys)
        return df.withColumns(
            {
                "pos": F.row_number().over(group.orderBy(ts)) - 1,
                "n_points": F.count(F.lit(1)).over(group),
                "n_values": F.count(value).over(group),
            }
        )
    hourly = df.withColumn("_hour", F.date_trunc("hour", F.col(ts))).where("_hour is not null")
    by_hour = W.partitionBy(*keys).orderBy("_hour")
    offsets = (
        hourly.groupBy(*keys, "_hour")
        .agg(F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_values"))
        .withColumns(
            {
                "_before": F.sum("_rows").over(by_hour) - F.col("_rows"),
                "n_points": F.sum("_rows").over(W.partitionBy(*keys)),
                "n_values": F.sum("_values").over(W.partitionBy(*keys)),
            }
        )
        .drop("_rows", "_values")
    )
    within = F.row_number().over(W.partitionBy(*keys, "_hour").orderBy(ts)) - 1
    return (
        hourly.join(offsets, [*keys, "_hour"])
        .withColumn("pos", F.col("_before") + within)
        .drop("_hour", "_before")
    )


def grouped_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median of ``value`` per ``keys`` as column ``median``.

    A bounded quantile sketch brackets the median (its rank error is 1/20000, the bracket six times as wide).
    Values below the bracket are only counted and those above it left out, both where they lie; equal values are folded
    into counts, and only the distinct values inside the bracket, less than a thousandth of a large group, are
    shuffled and ranked.  The brackets, one row per group, are broadcast.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull())
    bracket = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, [0.4997, 0.5003], 20000).alias("_q"),
    )
    placed = present.join(F.broadcast(bracket), keys).where(F.col(value) <= F.col("_q")[1])
    inside = F.when(F.col(value) >= F.col("_q")[0], F.col(value))
    counts = placed.groupBy(*keys, "_n", inside.alias("_value")).agg(F.count(F.lit(1)).alias("_c"))
    # the values below the bracket are the row without a value, which comes first
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_value")))
    ranked = counts.withColumn("_upto", upto).withColumns(
        {
            "_first": F.expr("(_n + 1) div 2"),
            "_second": F.expr("_n div 2 + 1"),
        }
    )
    # the value at rank r is the smallest one whose cumulative count reaches r
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_upto") >= F.col("_first"), F.col("_value")))
                + F.min(F.when(F.col("_upto") >= F.col("_second"), F.col("_value")))
            )
            / 2.0
        ).alias("median")
    )
