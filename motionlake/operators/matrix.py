"""Entity by metric matrices: pivot, imputation, scaling, correlation.

Only figures per metric (or per metric pair) reach the driver; entities stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folding import WIDEST, folded_means, unfolded
from ..functions.ordered import grouped_median
from ..session import settle
from .profiles import entity_means
from .selection import members

MAX_METRICS = 2000


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Matrix:
    """Complete matrix: one row per entity, one double column per metric, with its column statistics."""

    rows: DataFrame
    id: str
    metrics: list[str]
    n: int
    mean: np.ndarray
    std_pop: np.ndarray
    std_samp: np.ndarray

    def scaled(self, metric: str) -> Column:
        """Population z-score; a constant column becomes 0."""
        i = self.metrics.index(metric)
        spread = float(self.std_pop[i])
        return (quoted(metric) - float(self.mean[i])) / F.lit(spread if spread > 0 else 1.0)

    def without(self, dropped: set[str]) -> Matrix:
        keep = [i for i, m in enumerate(self.metrics) if m not in dropped]
        names = [self.metrics[i] for i in keep]
        return Matrix(
            self.rows.select(quoted(self.id), *[quoted(m) for m in names]),
            self.id, names, self.n, self.mean[keep], self.std_pop[keep], self.std_samp[keep],
        )

    def varying(self) -> Matrix:
        return self.without({m for m, s in zip(self.metrics, self.std_samp, strict=True) if not s > 0})

    def standardized(self) -> DataFrame:
        return self.rows.select(quoted(self.id), *[self.scaled(m).alias(m) for m in self.metrics])

    def long(self) -> DataFrame:
        return self.rows.unpivot(quoted(self.id), [quoted(m) for m in self.metrics], "metric", "value")

    def statistics(self) -> DataFrame:
        rows = [
            (m, float(a), float(s), float(p))
            for m, a, s, p in zip(self.metrics, self.mean, self.std_samp, self.std_pop, strict=True)
        ]
        return self.rows.sparkSession.createDataFrame(rows, "metric string, mean double, std_samp double, std_pop double")

    def correlation(self) -> np.ndarray:
        """Pearson matrix; constant columns correlate 0 with everything."""
        if self.n < 2:
            return np.full((len(self.metrics), len(self.metrics)), np.nan)
        vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(self.metrics))], outputCol="v").transform(
            self.rows.select(*[self.scaled(m).alias(f"x{i}") for i, m in enumerate(self.metrics)])
        )
        r = np.array(Correlation.corr(vectors.select("v"), "v").first()[0].toArray())
        return np.nan_to_num(r, nan=0.0)


def listed(metrics: DataFrame | Sequence[str]) -> list[str]:
    """Metric names on the driver, in name order; a matrix needs one column for each."""
    if not isinstance(metrics, DataFrame):
        names = sorted(set(metrics))
    else:
        names = sorted(r[0] for r in metrics.select("metric").distinct().limit(MAX_METRICS + 1).collect())
    if len(names) > MAX_METRICS:
        raise ValueError(f"more than {MAX_METRICS} metrics; choose some or stay with the long form")
    return names


def selected_means(measures: DataFrame, metrics: Sequence[str], entities: Sequence | DataFrame | None = None) -> DataFrame:
    chosen = members(measures, "metric", list(metrics))
    if entities is not None:
        chosen = members(chosen, "entity", entities)
    names = list(dict.fromkeys(metrics))
    if not 0 < len(names) <= WIDEST:
        return entity_means(chosen).where("value is not null")
    folded = folded_means(chosen.where("entity is not null"), ["entity"], names)
    return unfolded(folded, ["entity"], names).where("value is not null")


def entity_matrix(measures: DataFrame, metrics: Sequence[str], entities: Sequence | DataFrame | None = None) -> DataFrame:
    """Mean of every metric per entity, NULL where nothing was measured."""
    return pivoted(selected_means(measures, metrics, entities), metrics)


def pivoted(means: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per entity.  Few metrics are grouped by entity alone, without a grouping by entity and metric before it."""
    if not 0 < len(metrics) <= WIDEST:
        return means.groupBy("entity").pivot("metric", list(metrics)).agg(F.first("value"))
    cells = [F.first(F.when(F.col("metric") == m, F.col("value")), ignorenulls=True).alias(m) for m in metrics]
    return means.groupBy("entity").agg(*cells)


def complete_matrix(
    means: DataFrame, entities: DataFrame | None = None, metrics: Sequence[str] | None = None
) -> Matrix:
    """Matrix from (entity, metric, value) means with missing cells set to the metric's median.

    Mean and spread after imputation follow from the present values and the number of missing ones, so no
    aggregate over thousands of columns is needed.  ``entities`` may name entities beyond those in ``means``.
    Of few ``metrics``, named by the caller, only the pivoted means are written down.
    """
    if metrics is not None and 0 < len(set(metrics)) <= WIDEST:
        asked = sorted(set(metrics))
        wide = settle(pivoted(members(means, "metric", asked), asked))
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), quoted(m).alias("value")) for m in asked])
        means = wide.select("entity", F.inline(cells)).where("value is not null")
        present = wide.select("entity")
    else:
        wide, means = None, settle(means if metrics is None else members(means, "metric", list(metrics)))
        present = means.select("entity").distinct()
    everyone = present if entities is None else entities.select("entity").union(present).distinct()
    n = everyone.count()
    per_metric = (
        means.groupBy("metric")
        .agg(F.count("value").alias("k"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))
        .orderBy("metric")
        .collect()
    )
    names = [r["metric"] for r in per_metric]
    k, mean, m2 = (np.array([r[c] for r in per_metric], dtype=float) for c in ("k", "mean", "m2"))
    missing = n - k
    gaps = [m for m, holes in zip(names, missing, strict=True) if holes > 0]
    medians = {}
    if gaps:
        medians = dict(grouped_median(members(means, "metric", gaps), ["metric"], "value").collect())
    median = np.array([medians.get(m, 0.0) for m in names])
    grand = (k * mean + missing * median) / max(n, 1)
    squares = m2 + k * (mean - grand) ** 2 + missing * (median - grand) ** 2
    if wide is None:
        wide = pivoted(means, names)
    if entities is not None:
        wide = everyone.join(wide, "entity", "left")
    rows = wide.select(
        "entity", *[F.coalesce(quoted(m), F.lit(medians[m])).alias(m) if m in medians else quoted(m) for m in names]
    )
    return Matrix(
        rows, "entity", names, n, grand, np.sqrt(squares / max(n, 1)), np.sqrt(squares / max(n - 1, 1))
    )


def matrix_of(table: DataFrame, id: str, columns: Sequence[str]) -> Matrix:
    """Matrix over the complete numeric ``columns`` of a table with one row per ``id``."""
    rows = table.select(id, *columns)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop, F.stddev_samp)],
    ).first()

    def of(name: str) -> np.ndarray:
        return np.array([stats[f"{name}_{c}"] or 0.0 for c in columns], dtype=float)

    return Matrix(rows, id, list(columns), stats["n"], of("avg"), of("stddev_pop"), of("stddev_samp"))


def correlation_pairs(matrix: Matrix, max_metrics: int | None = None) -> DataFrame:
    """Correlation of every metric pair in long form, on the ``max_metrics`` of highest variance."""
    if max_metrics is not None and len(matrix.metrics) > max_metrics:
        by_spread = sorted(zip(-matrix.std_samp, matrix.metrics, strict=True))
        matrix = matrix.without({m for _, m in by_spread[max_metrics:]})
    r = matrix.correlation()
    rows = [
        (a, b, float(r[i, j])) for i, a in enumerate(matrix.metrics) for j, b in enumerate(matrix.metrics)
    ]
    return matrix.rows.sparkSession.createDataFrame(rows, "metric_a string, metric_b string, r double")
