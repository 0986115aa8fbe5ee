"""Choosing rows and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

INLINE_LIMIT = 1000


def test_types(measures: DataFrame) -> DataFrame:
    """Sorted distinct test types: from the type column, else read off the metric names, else one catch-all."""
    for column in ("test_type", "jump_type"):
        if column in measures.columns:
            return (
                measures.where(F.col(column).isNotNull())
                .select(F.col(column).alias("test_type"))
                .distinct()
                .orderBy("test_type")
            )
    name = F.upper("metric")
    first, *others = rules.TEST_KINDS
    kind = F.when(name.contains(first), first)
    for other in others:
        kind = kind.when(name.contains(other), other)
    found = measures.select("metric").distinct().select(kind.alias("test_type")).where("test_type is not null").distinct()
    fallback = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(rules.ALL_TESTS).alias("test_type"))
    return found.unionByName(fallback).orderBy("test_type")


def of_test_type(measures: DataFrame, kind: str) -> DataFrame:
    """Rows of one test type; without a type column the metric name is searched by regular expression."""
    if kind == rules.ALL_TESTS:
        return measures
    for column in ("test_type", "jump_type"):
        if column in measures.columns:
            return measures.where(F.col(column) == kind)
    if "metric" in measures.columns:
        return measures.where(F.col("metric").rlike(f"(?i){kind}"))
    return measures


def top_entities(measures: DataFrame, n: int = 20) -> DataFrame:
    return (
        measures.where("entity is not null")
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "entity")
        .limit(n)
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def in_dates(df: DataFrame, start: date, end: date, ts: str = "test_ts") -> DataFrame:
    """Inclusive calendar range, as bounds on the stored timestamp so that files can be skipped."""
    after = end + timedelta(days=1)
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(after).cast("timestamp_ntz")))


def members(df: DataFrame, column: str, chosen: Sequence | DataFrame) -> DataFrame:
    """Rows whose ``column`` is in a short list (pushed to the scan) or in a table (semi join)."""
    if not isinstance(chosen, DataFrame):
        if len(chosen) <= INLINE_LIMIT:
            return df.where(F.col(column).isin(list(chosen)))
        kind = df.schema[column].dataType
        chosen = df.sparkSession.createDataFrame([(v,) for v in chosen], f"`{column}` {kind.simpleString()}")
    return df.join(chosen.select(column).distinct(), column, "left_semi")


def name_has_any(patterns: Sequence[str]) -> Column:
    upper = F.upper("metric")
    found = F.lit(False)
    for pattern in patterns:
        found = found | upper.contains(pattern.upper())
    return found


def matching_metrics(metrics: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return metrics.where(name_has_any(patterns))


def search_metrics(metrics: DataFrame, term: str = "", preset: str = "All") -> DataFrame:
    patterns = rules.PRESETS.get(preset, ())
    if patterns:
        metrics = matching_metrics(metrics, patterns)
    return matching_metrics(metrics, [term]) if term else metrics


def _labelled(metrics: DataFrame, labels: Sequence[rules.Rule], name: str) -> DataFrame:
    hits = [
        F.when(rule.matches(F.col("metric")), F.struct(F.lit(i).alias("position"), F.lit(rule.label).alias(name)))
        for i, rule in enumerate(labels)
    ]
    return metrics.select("*", F.inline(F.array_compact(F.array(*hits))))


def metric_categories(metrics: DataFrame) -> DataFrame:
    """One row per (metric, category); a metric may be in several."""
    return _labelled(metrics, rules.CATEGORIES, "category")


def metric_families(metrics: DataFrame) -> DataFrame:
    return _labelled(metrics, rules.FAMILIES, "family")


def category_counts(metrics: DataFrame, labels: Sequence[rules.Rule] = rules.CATEGORIES) -> DataFrame:
    """Metrics per category, zero included."""
    counts = [F.count_if(rule.matches(F.col("metric"))).alias(f"n{i}") for i, rule in enumerate(labels)]
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(rule.label).alias("category"), F.col(f"n{i}").alias("metrics"))
        for i, rule in enumerate(labels)
    ]
    return metrics.select("metric").distinct().agg(*counts).select(F.inline(F.array(*rows)))


def chosen_metrics(profile: DataFrame, categories: Sequence[str], k: int) -> DataFrame:
    """First ``k`` metrics of the chosen categories, each at its first occurrence.

    Inside a category metrics follow the profile's order: completeness, then name.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    return (
        metric_categories(profile)
        .where(F.col("category").isin(list(categories)))
        .groupBy("metric", "completeness_pct")
        .agg(F.min(order).cast("int").alias("category_position"))
        .orderBy("category_position", F.desc_nulls_last("completeness_pct"), "metric")
        .limit(k)
        .select("metric", "category_position")
    )
