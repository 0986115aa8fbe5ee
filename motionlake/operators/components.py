"""Principal components of an entity matrix.

Everything here works on the p x p correlation matrix (p metrics); only the scores touch entities, as a
projection inside Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..functions.tails import chi2_tail
from .matrix import Matrix

BIPLOT_METRICS = 10
HIGH_LOADING = 0.3
#: Keeps quotients defined; log of the least determinant.
TINY = 1e-10
LEAST_LOG = math.log(1e-300)


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues (variance with n-1), their shares, and unit components by falling eigenvalue.

    Each component's largest loading by size is positive.
    """

    eigenvalues: np.ndarray
    ratios: np.ndarray
    components: np.ndarray
    n: int


def spectrum(matrix: Matrix, r: np.ndarray | None = None) -> Spectrum:
    r = matrix.correlation() if r is None else r
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1][: min(matrix.n, len(matrix.metrics))]
    eigenvalues = np.clip(values[order], 0, None) * matrix.n / max(matrix.n - 1, 1)
    components = vectors[:, order].T
    lead = np.argmax(np.abs(components), axis=1)
    signs = np.sign(components[np.arange(len(components)), lead])
    total = eigenvalues.sum()
    ratios = eigenvalues / total if total > 0 else np.zeros_like(eigenvalues)
    return Spectrum(eigenvalues, ratios, components * signs[:, None], matrix.n)


class Suitability(NamedTuple):
    """Whether metrics share enough variance for components; NULL where the correlations are undefined."""

    kmo: float | None = None
    bartlett_chi2: float | None = None
    bartlett_p: float | None = None
    bartlett_dof: int | None = None


def partial_correlations(r: np.ndarray) -> np.ndarray:
    """Correlation of each two metrics with all others held fixed, from the precision matrix; its diagonal is 0."""
    precision = np.linalg.pinv(r)
    own = np.diag(precision) + TINY
    partial = -precision / np.sqrt(own[:, None] * own[None, :])
    np.fill_diagonal(partial, 0.0)
    return partial


def suitability(r: np.ndarray, n: int) -> Suitability:
    """Sampling adequacy (share of plain in plain and partial squared correlations) and Bartlett's sphericity test."""
    p = len(r)
    if not np.isfinite(r).all():
        return Suitability()
    shared = np.square(r).sum() - np.square(np.diag(r)).sum()
    kmo = shared / (shared + np.square(partial_correlations(r)).sum() + TINY)
    sign, log_determinant = np.linalg.slogdet(r)
    log_determinant = max(log_determinant, LEAST_LOG) if sign > 0 else LEAST_LOG
    chi2 = float(((2 * p + 5) / 6 - (n - 1)) * log_determinant)
    if not (math.isfinite(kmo) and math.isfinite(chi2)):
        return Suitability()
    dof = p * (p - 1) // 2
    return Suitability(round(float(kmo), 3), round(chi2, 1), chi2_tail(chi2, dof), dof)


def parallel_thresholds(
    spark: SparkSession, n: int, p: int, iterations: int = 100, percentile: float = 95, seed: int = 42
) -> np.ndarray:
    """Percentile of each ranked correlation eigenvalue over random normal data of n rows and p columns.

    One simulation per row of a range.  With many rows only the p x p scatter matrix is drawn (Bartlett's
    decomposition), so memory stays p squared whatever n is.
    """

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                if n - 1 >= p:
                    factor = np.tril(rng.standard_normal((p, p)), -1)
                    factor[np.diag_indices(p)] = np.sqrt(rng.chisquare(n - 1 - np.arange(p)))
                    scatter = factor @ factor.T
                else:
                    sample = rng.standard_normal((n, p))
                    sample -= sample.mean(axis=0)
                    scatter = sample.T @ sample
                spread = np.sqrt(np.diag(scatter))
                values = np.linalg.eigvalsh(scatter / np.outer(spread, spread))[::-1]
                yield pd.DataFrame({"rank": np.arange(p), "eigenvalue": values})

    rows = (
        spark.range(0, iterations, 1, min(iterations, spark.sparkContext.defaultParallelism))
        .mapInPandas(simulate, "rank int, eigenvalue double")
        .groupBy("rank")
        .agg(F.percentile("eigenvalue", percentile / 100.0).alias("threshold"))
        .orderBy("rank")
        .collect()
    )
    return np.array([r["threshold"] for r in rows])


def kaiser_count(s: Spectrum) -> int:
    return max(1, int((s.eigenvalues > 1.0).sum()))


def parallel_count(s: Spectrum, thresholds: np.ndarray) -> int:
    """Eigenvalues above chance; with fewer entities than metrics the ranks do not line up and Kaiser decides."""
    if len(thresholds) != len(s.eigenvalues):
        return kaiser_count(s)
    return max(1, int((s.eigenvalues > thresholds).sum()))


def component_count(s: Spectrum, thresholds: np.ndarray) -> int:
    p = s.components.shape[1]
    return max(2, min(kaiser_count(s), parallel_count(s, thresholds), p, s.n))


def scores(matrix: Matrix, s: Spectrum, k: int) -> DataFrame:
    """First ``k`` component scores per entity."""
    k = min(k, len(s.components))
    z = {m: matrix.scaled(m) for m in matrix.metrics}
    columns = [
        sum((z[m] * float(w) for m, w in zip(matrix.metrics, s.components[j], strict=True)), F.lit(0.0)).alias(f"PC{j + 1}")
        for j in range(k)
    ]
    return matrix.rows.select(matrix.id, *columns)


def variance_table(spark: SparkSession, s: Spectrum, k: int) -> DataFrame:
    """Eigenvalue, share and running share of the first ``k`` components."""
    total = np.cumsum(s.ratios)
    rows = [
        (f"PC{j + 1}", float(s.eigenvalues[j]), float(s.ratios[j]), float(total[j]))
        for j in range(min(k, len(s.eigenvalues)))
    ]
    return spark.createDataFrame(rows, "component string, eigenvalue double, ratio double, cumulative double")


def loadings(spark: SparkSession, matrix: Matrix, s: Spectrum, k: int) -> DataFrame:
    rows = [
        (f"PC{j + 1}", m, float(s.components[j][i]), float(s.ratios[j]))
        for j in range(min(k, len(s.components)))
        for i, m in enumerate(matrix.metrics)
    ]
    return spark.createDataFrame(rows, "component string, metric string, loading double, ratio double")


def feature_importance(loadings: DataFrame, n: int = 10) -> DataFrame:
    """Loadings by size, weighted with the share of variance, summed over components."""
    return (
        loadings.groupBy("metric")
        .agg(F.sum(F.abs("loading") * F.col("ratio")).alias("importance"))
        .orderBy(F.desc("importance"), "metric")
        .limit(n)
    )


def top_loadings(loadings: DataFrame, n: int = 10, named: int = 3) -> DataFrame:
    """The ``n`` largest loadings by size per component.

    ``contribution`` names the first ``named`` strong ones of each sign.
    """
    by_size = W.partitionBy("component").orderBy(F.desc(F.abs("loading")), "metric")
    sign = F.when(F.col("loading") > HIGH_LOADING, "high positive").when(F.col("loading") < -HIGH_LOADING, "high negative")
    within = F.row_number().over(W.partitionBy("component", "_sign").orderBy("rank"))
    return (
        loadings.withColumn("rank", F.row_number().over(by_size))
        .where(F.col("rank") <= n)
        .withColumn("_sign", sign)
        .withColumn("contribution", F.when(within <= named, F.col("_sign")))
        .select("component", "rank", "metric", "loading", "contribution")
    )


def biplot(pc_scores: DataFrame, id: str, loadings: DataFrame, n: int = BIPLOT_METRICS) -> DataFrame:
    """Scores and the ``n`` longest loadings on the first two components, each scaled to at most 1."""
    floor = F.lit(1e-10)
    widest = pc_scores.agg(F.max(F.greatest(F.abs("PC1"), F.abs("PC2")))).scalar()
    points = pc_scores.select(
        F.lit("score").alias("kind"),
        F.col(id).cast("string").alias("label"),
        (F.col("PC1") / F.greatest(widest, floor)).alias("x"),
        (F.col("PC2") / F.greatest(widest, floor)).alias("y"),
    )
    pair = (
        loadings.where(F.col("component").isin("PC1", "PC2"))
        .groupBy("metric")
        .pivot("component", ["PC1", "PC2"])
        .agg(F.first("loading"))
    )
    longest = pair.agg(F.max(F.greatest(F.abs("PC1"), F.abs("PC2")))).scalar()
    arrows = (
        pair.select(
            F.lit("loading").alias("kind"),
            F.col("metric").alias("label"),
            (F.col("PC1") / F.greatest(longest, floor)).alias("x"),
            (F.col("PC2") / F.greatest(longest, floor)).alias("y"),
        )
        .orderBy(F.desc(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), "label")
        .limit(n)
    )
    return points.unionByName(arrows)


def export_table(labelled_scores: DataFrame, id: str = "entity") -> DataFrame:
    """Entity, cluster from 1, and three rounded scores (0 for a component that was not kept)."""
    pcs = [
        (half_even(F.col(f"PC{j}"), 4) if f"PC{j}" in labelled_scores.columns else F.lit(0.0)).alias(f"PC{j}")
        for j in (1, 2, 3)
    ]
    return labelled_scores.select(id, (F.col("cluster") + 1).alias("cluster"), *pcs)
