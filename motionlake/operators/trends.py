"""Trends of every metric of every entity over its timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.folding import few_metrics, folded_means, has, unfolded, value
from ..functions.numeric import bind, half_even, percent
from ..functions.ordered import with_position
from ..functions.tails import student_t_two_sided

SERIES = ["entity", "metric"]


def _dated(measures: DataFrame) -> DataFrame:
    return measures.where("entity is not null and metric is not null and test_ts is not null")


def points_over_time(measures: DataFrame, gathered: bool = False) -> DataFrame:
    """Mean value per entity, metric and exact timestamp.

    Few metrics travel together, one row per entity and timestamp; ``gathered`` then brings an entity's points together,
    still folded, for those who rank them next.
    """
    names = few_metrics(measures)
    if names is None:
        return _dated(measures).groupBy(*SERIES, "test_ts").agg(F.avg("value").alias("value"))
    folded = folded_means(_dated(measures), ["entity", "test_ts"], names)
    if gathered:
        folded = folded.repartition("entity")
    return unfolded(folded, ["entity", "test_ts"], names).select(*SERIES, "test_ts", "value")


def improvement(first: Column, last: Column) -> Column:
    """Change relative to the size of the first value, 0 when that is 0."""
    return F.when(first == 0, F.lit(0.0)).otherwise(percent(last - first, F.abs(first)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def slope_p_value(n: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Two-sided p of a regression slope: 1 for a constant series, 0 for a perfect line."""

    def p_value(r: Column) -> Column:
        open_part = (1.0 - r) * (1.0 + r)
        t = r * F.sqrt(F.try_divide((n - 2).cast("double"), open_part))
        return F.when(open_part <= 0, F.lit(0.0)).otherwise(student_t_two_sided(t, n - 2))

    r = F.when(syy == 0, F.lit(0.0)).otherwise(F.try_divide(sxy, F.sqrt(sxx * syy)))
    return F.when(n >= 3, bind(r, p_value))


def improvement_report(measures: DataFrame) -> DataFrame:
    """First-to-last improvement, trend significance and half-split effect size per entity and metric.

    Points without a value count as points.  A series that has one gets no p-value (``ns``) and no effect size.
    Dates bound an entity's points, so they are gathered; points at timestamps stay spread (see ``with_position``).
    """
    points = points_over_time(measures, gathered=isinstance(measures.schema["test_ts"].dataType, DateType))
    half = F.floor(F.col("n_points") / 2)
    early = F.when(F.col("pos") < half, F.col("value"))
    late = F.when(F.col("pos") >= half, F.col("value"))
    report = (
        with_position(points, SERIES, "test_ts", "value")
        .groupBy(*SERIES)
        .agg(
            F.min_by("value", "pos").alias("first_value"),
            F.max_by("value", "pos").alias("last_value"),
            F.count(F.lit(1)).alias("data_points"),
            F.max("n_values").alias("_values"),
            F.regr_sxx("value", "pos").alias("_sxx"),
            F.regr_syy("value", "pos").alias("_syy"),
            F.regr_sxy("value", "pos").alias("_sxy"),
            F.avg(late).alias("_late"),
            F.avg(early).alias("_early"),
            F.var_samp(early).alias("_early_var"),
            F.var_samp(late).alias("_late_var"),
        )
        .where("data_points >= 2")
    )
    n = F.col("data_points")
    whole = F.col("_values") == n
    p = F.when(whole, slope_p_value(n, F.col("_sxx"), F.col("_syy"), F.col("_sxy")))
    sd = F.sqrt((F.col("_early_var") + F.col("_late_var")) / 2.0)
    return (
        report.withColumns({"p_value": p, "_sd": F.when(whole & (n >= 3), sd)})
        .withColumns(
            {
                "improvement_pct": improvement(F.col("first_value"), F.col("last_value")),
                "significance": F.when(n < 3, "N/A").otherwise(stars(F.col("p_value"))),
                "effect_size": F.when(F.col("_sd") > 0, F.try_divide(F.col("_late") - F.col("_early"), F.col("_sd"))),
            }
        )
        .select(
            *SERIES, "improvement_pct", "first_value", "last_value", "data_points", "p_value", "significance", "effect_size"
        )
    )


def first_to_last(measures: DataFrame) -> DataFrame:
    """Improvement only: no ranking of points, one pass of mergeable aggregates.

    Few metrics travel together, one row per entity and timestamp and then one per entity.
    """
    names = few_metrics(measures)
    if names is None:
        ends = (
            points_over_time(measures)
            .groupBy(*SERIES)
            .agg(
                F.min_by("value", "test_ts").alias("first_value"),
                F.max_by("value", "test_ts").alias("last_value"),
                F.count(F.lit(1)).alias("data_points"),
            )
        )
    else:
        ends = _folded_ends(folded_means(_dated(measures), ["entity", "test_ts"], names), names)
    return ends.where("data_points >= 2").withColumn("improvement_pct", improvement(F.col("first_value"), F.col("last_value")))


def _folded_ends(folded: DataFrame, names: Sequence[str]) -> DataFrame:
    """First value, last value and number of points of every series of folded means."""
    columns = []
    for i in range(len(names)):
        ts = F.when(has(i), F.col("test_ts"))
        columns += [F.min_by(value(i), ts).alias(f"_a{i}"), F.max_by(value(i), ts).alias(f"_z{i}"), F.count(ts).alias(f"_n{i}")]
    parts = [
        F.struct(F.lit(m).alias("metric"), F.col(f"_a{i}").alias("first_value"), F.col(f"_z{i}").alias("last_value"), F.col(f"_n{i}").alias("data_points"))
        for i, m in enumerate(names)
    ]
    return folded.groupBy("entity").agg(*columns).select("entity", F.inline(F.array(*parts)))


def entity_improvement(report: DataFrame) -> DataFrame:
    return report.groupBy("entity").agg(half_even(F.avg("improvement_pct"), 1).alias("improvement_pct"))


def improvement_leaders(report: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best entities if they improved and the ``n`` worst if they fell."""
    per_entity = entity_improvement(report).where("improvement_pct is not null")
    best = per_entity.orderBy(F.desc("improvement_pct"), "entity").limit(n).where("improvement_pct > 0")
    worst = per_entity.orderBy("improvement_pct", F.desc("entity")).limit(n).where("improvement_pct < 0")
    return best.withColumn("board", F.lit("top")).unionByName(worst.withColumn("board", F.lit("bottom")))


def improvement_matrix(report: DataFrame, metrics: Sequence[str]) -> DataFrame:
    wide = report.groupBy("entity").pivot("metric", list(metrics)).agg(F.avg("improvement_pct"))
    return wide.select("entity", *[half_even(F.col(f"`{m}`"), 1).alias(m) for m in metrics])
