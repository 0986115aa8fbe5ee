"""Means of a few metrics, folded into one row per key before the shuffle.

A test has one row per metric.  Grouped by key and metric each of them travels on its own, with the key and the metric's
name; folded, the key travels once with a sum and a count per metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that are folded at most; a bit of one integer marks each.
WIDEST = 32


def few_metrics(measures: DataFrame) -> list[str] | None:
    """The metrics of a table, in name order, if they are few enough to fold; None if not, or without any."""
    found = measures.where("metric is not null").select("metric").distinct().limit(WIDEST + 1).collect()
    return sorted(r[0] for r in found) if 0 < len(found) <= WIDEST else None


def has(i: int) -> Column:
    """Whether a folded row has measures, null ones included, of metric ``i``."""
    return F.col("_has").bitwiseAND(F.lit(1 << i)) != 0


def value(i: int) -> Column:
    return F.col(f"_v{i}")


def folded_means(measures: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key: the mean of each of ``names`` (see :func:`value`) and which of them were measured (:func:`has`)."""
    bit = F.lit(None).cast("long")
    for i, name in enumerate(names):
        bit = F.when(F.col("metric") == name, F.lit(1 << i).cast("long")).otherwise(bit)
    means = [F.avg(F.when(F.col("metric") == name, F.col("value"))).alias(f"_v{i}") for i, name in enumerate(names)]
    return measures.groupBy(*keys).agg(F.bit_or(bit).alias("_has"), *means)


def unfolded(folded: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``keys, metric, value``: the folded means as one row for each metric that was measured."""
    parts = [F.struct(F.lit(name).alias("metric"), value(i).alias("value"), has(i).alias("_there")) for i, name in enumerate(names)]
    return folded.select(*keys, F.inline(F.array(*parts))).where("_there").select(*keys, "metric", "value")


def metric_totals(measures: DataFrame, names: Sequence[str]) -> DataFrame:
    """``entity, metric, results, total, dates``: number and sum of the values of each of ``names``, and its different days.

    Rows are folded by entity and month, the days of each metric as bits of a number, so what travels is neither a row per
    metric nor one per day.  Metrics without any value are left out.
    """

    def of(name: str, column: str) -> Column:
        return F.when(F.col("metric") == name, F.col(column))

    days = measures.select("entity", "metric", "value", F.to_date("test_ts").alias("_day"))
    marked = days.select("entity", "metric", "value", F.trunc("_day", "month").alias("_month"), F.expr("shiftleft(1, day(_day) - 1)").alias("_bit"))
    monthly, sums, parts = [], [], []
    for i, name in enumerate(names):
        monthly += [F.count(of(name, "value")).alias(f"_n{i}"), F.sum(of(name, "value")).alias(f"_s{i}"), F.bit_or(of(name, "_bit")).alias(f"_d{i}")]
        sums += [F.sum(f"_n{i}").alias(f"_n{i}"), F.sum(f"_s{i}").alias(f"_s{i}"), F.sum(F.coalesce(F.bit_count(f"_d{i}"), F.lit(0))).alias(f"_d{i}")]
        columns = {"results": f"_n{i}", "total": f"_s{i}", "dates": f"_d{i}"}
        parts.append(F.struct(F.lit(name).alias("metric"), *[F.col(c).alias(alias) for alias, c in columns.items()]))
    totals = marked.groupBy("entity", "_month").agg(*monthly).groupBy("entity").agg(*sums)
    return totals.select("entity", F.inline(F.array(*parts))).where("results > 0")
