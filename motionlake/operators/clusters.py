"""Clusters of entities, their quality and what sets them apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import band
from ..session import settle
from .components import (
    Spectrum,
    Suitability,
    component_count,
    export_table,
    kaiser_count,
    loadings,
    parallel_count,
    parallel_thresholds,
    scores,
    spectrum,
    suitability,
)
from .matrix import Matrix, complete_matrix, listed, selected_means

SEED = 42
RESTARTS = 10
SEED_POINTS = 10_000
ITERATIONS = 300
TOLERANCE = 1e-4
SILHOUETTE_BLOCK = 16_384
SILHOUETTE_CHUNK = 64
#: Blocks that are formed for their small size alone; pairs of blocks grow with its square.
SILHOUETTE_BLOCKS = 48


def _seeds(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starting centres: points drawn one after another, by their squared distance to the centres so far."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    while len(centres) < k:
        gaps = np.min([((sample - c) ** 2).sum(axis=1) for c in centres], axis=0)
        if not gaps.any():  # fewer different points than clusters
            break
        centres.append(sample[rng.choice(len(sample), p=gaps / gaps.sum())])
    return np.array(centres)


def restart_sums(points: DataFrame, columns: Sequence[str], centres: list[np.ndarray]) -> dict[int, pd.DataFrame]:
    """One pass for all restarts: size, coordinate sums and squared distances of what lies nearest to each centre.

    A task returns one row per restart and cluster, whatever it reads; partial rows are added up by key.
    """
    dims = list(columns)
    names = [f"s{i}" for i in range(len(dims))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(c), len(dims) + 2)) for c in centres]
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(dims))])
            if np.isnan(x).any():
                raise ValueError("k-means needs a value in every column")
            for own, c in zip(held, centres, strict=True):
                gaps = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
                nearest = gaps.argmin(axis=1)
                for j, values in enumerate([np.ones(len(x)), gaps.min(axis=1), *x.T]):
                    own[:, j] += np.bincount(nearest, values, len(c))
        rows = [(r, i, *own[i].tolist()) for r, own in enumerate(held) for i in range(len(own))]
        yield pa.RecordBatch.from_pylist([dict(zip(["restart", "place", "n", "cost", *names], row, strict=True)) for row in rows], schema)

    schema = pa.schema([("restart", pa.int32()), ("place", pa.int32()), *[(n, pa.float64()) for n in ("n", "cost", *names)]])
    spec = "restart int, place int, " + ", ".join(f"{n} double" for n in ("n", "cost", *names))
    sums = points.select(*dims).mapInArrow(partial, spec).groupBy("restart", "place").agg(*[F.sum(n).alias(n) for n in ("n", "cost", *names)])
    # restarts x clusters rows
    return dict(iter(sums.toPandas().sort_values(["restart", "place"]).groupby("restart")))


def kmeans_labels(points: DataFrame, id: str, columns: Sequence[str], k: int, restarts: int = RESTARTS) -> DataFrame:
    """Add ``cluster``: the best of ``restarts`` k-means runs, numbered by each cluster's smallest ``id``.

    All restarts move in one pass over the points per iteration.  They start from at most ``SEED_POINTS`` points, drawn by a
    hash of the id; a restart ends when no centre moves by more than ``TOLERANCE``, after ``ITERATIONS`` passes at the latest.
    A centre that loses all its points stays where it is.  With fewer different points than ``k`` there are fewer clusters.
    """
    points = settle(points)
    drawn = points.orderBy(F.xxhash64(F.col(id).cast("string")), id).limit(SEED_POINTS).select(*columns).toPandas().to_numpy(float)
    if not len(drawn):
        return points.withColumn("cluster", F.lit(0))
    centres = [_seeds(drawn, k, SEED + r) for r in range(restarts)]
    moving = set(range(restarts))
    for _ in range(ITERATIONS):
        order = sorted(moving)
        for r, found in restart_sums(points, columns, [centres[r] for r in order]).items():
            size = found["n"].to_numpy()[:, None]
            moved = np.where(size > 0, found.filter(regex="^s").to_numpy() / np.maximum(size, 1), centres[order[r]])
            if ((moved - centres[order[r]]) ** 2).sum(axis=1).max() <= TOLERANCE**2:
                moving.discard(order[r])
            centres[order[r]] = moved
        if not moving:
            break
    costs = {r: found["cost"].sum() for r, found in restart_sums(points, columns, centres).items()}
    best = centres[min(costs, key=lambda r: (round(costs[r], 9), r))]

    def squares(centre: np.ndarray) -> Column:
        return reduce(Column.__add__, [(F.col(d) - F.lit(float(v))) * (F.col(d) - F.lit(float(v))) for d, v in zip(columns, centre, strict=True)])

    nearest = F.array_min(F.array(*[F.struct(squares(c).alias("gap"), F.lit(i).alias("place")) for i, c in enumerate(best)]))["place"]
    assigned = points.withColumn("_p", nearest)
    first = assigned.groupBy("_p").agg(F.min(id).alias("lead")).orderBy("lead").collect()
    number = F.create_map(*[F.lit(v) for i, row in enumerate(first) for v in (row["_p"], i)])
    return assigned.withColumn("cluster", number[F.col("_p")]).drop("_p")


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def silhouette_blocks(n: int, block: int) -> int:
    """Blocks for ``n`` points: of ``block`` each, or fewer and larger ones, of up to ``SILHOUETTE_BLOCK`` points."""
    return max(1, min(-(-n // block), max(SILHOUETTE_BLOCKS, -(-n // SILHOUETTE_BLOCK))))


def distance_sums(labelled: DataFrame, id: str, columns: Sequence[str], block: int = SILHOUETTE_BLOCK) -> DataFrame:
    """Sum of Euclidean distances from every point to every cluster: (id, cluster, other, total).

    The points are hashed into blocks of about ``block``; each pair of blocks meets once, in a task that returns the sums
    per cluster of both sides, never pairs.  Blocks smaller than ``SILHOUETTE_BLOCK`` hold more points once there would be
    over ``SILHOUETTE_BLOCKS`` of them, so neither the pairs of blocks nor a point's journeys grow with the square of a small
    ``block``.  Distances are formed ``SILHOUETTE_CHUNK`` rows at a time, so memory per task is constant; a point travels
    as often as there are blocks, and once more.  Work is quadratic by definition of the measure.
    """
    dims, chunk = list(columns), SILHOUETTE_CHUNK
    n = labelled.count()
    blocks = silhouette_blocks(n, block)
    own = F.pmod(F.hash(id), F.lit(blocks))
    base = labelled.select(id, F.col("cluster").cast("int").alias("cluster"), *dims)
    kind = base.schema[id].dataType.simpleString()
    left = base.withColumn("_a", own).withColumn("_b", F.explode(F.sequence("_a", F.lit(blocks - 1))))
    right = base.withColumn("_b", own).withColumn("_a", F.explode(F.sequence(F.lit(0), "_b")))

    def meet(key: tuple, these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        x, y = these[dims].to_numpy(float), those[dims].to_numpy(float)
        kinds, at_x = np.unique(these["cluster"].to_numpy(), return_inverse=True)
        others, at_y = np.unique(those["cluster"].to_numpy(), return_inverse=True)
        in_x, in_y = np.eye(len(kinds))[at_x], np.eye(len(others))[at_y]
        to_y, to_x = np.zeros((len(x), len(others))), np.zeros((len(y), len(kinds)))
        for start in range(0, len(x), chunk):
            part = slice(start, start + chunk)
            squares = np.zeros((len(x[part]), len(y)))
            for d in range(len(dims)):
                squares += (x[part, d, None] - y[None, :, d]) ** 2
            gaps = np.sqrt(squares)
            to_y[part] = gaps @ in_y
            to_x += gaps.T @ in_x[part]
        sides = [(these, others, to_y)] + ([(those, kinds, to_x)] if key[0] != key[1] else [])
        parts = [
            pd.DataFrame({id: points[id], "cluster": points["cluster"], "other": other, "total": totals[:, j]})
            for points, found, totals in sides
            for j, other in enumerate(found)
        ]
        return pd.concat(parts) if parts else pd.DataFrame(columns=[id, "cluster", "other", "total"])

    return (
        left.groupBy("_a", "_b")
        .cogroup(right.groupBy("_a", "_b"))
        .applyInPandas(meet, f"`{id}` {kind}, cluster int, other int, total double")
        .groupBy(id, "cluster", "other")
        .agg(F.sum("total").alias("total"))
    )


def silhouettes(labelled: DataFrame, id: str, columns: Sequence[str], block: int = SILHOUETTE_BLOCK) -> DataFrame:
    """Exact Euclidean silhouette of every point; 0 for a point alone in its cluster."""
    sizes = cluster_sizes(labelled).select(F.col("cluster").cast("int").alias("other"), "size")
    mine = F.col("cluster") == F.col("other")
    widths = (
        distance_sums(labelled, id, columns, block)
        .join(sizes, "other")
        .groupBy(id, "cluster")
        .agg(
            F.max(F.when(mine, F.col("size"))).alias("_size"),
            F.max(F.when(mine, F.try_divide(F.col("total"), F.col("size") - 1))).alias("_inside"),
            F.min(F.when(~mine, F.col("total") / F.col("size"))).alias("_nearest"),
        )
    )
    width = F.try_divide(F.col("_nearest") - F.col("_inside"), F.greatest("_nearest", "_inside"))
    return widths.select(id, "cluster", F.when(F.col("_size") > 1, F.coalesce(width, F.lit(0.0))).otherwise(F.lit(0.0)).alias("silhouette"))


def _overall(points: DataFrame) -> DataFrame:
    """Mean silhouette with its quality band; NULL unless there are 2..n-1 clusters."""
    score = F.when((F.col("clusters") >= 2) & (F.col("clusters") < F.col("points")), F.col("_mean"))
    return (
        points.agg(
            F.avg("silhouette").alias("_mean"),
            F.countDistinct("cluster").alias("clusters"),
            F.count(F.lit(1)).alias("points"),
        )
        .withColumn("silhouette", score)
        .withColumn("quality", band(F.col("silhouette"), [(0.25, "Poor"), (0.5, "Fair"), (0.75, "Good")], "Excellent"))
        .select("silhouette", "quality", "clusters", "points")
    )


def silhouette_score(labelled: DataFrame, id: str, columns: Sequence[str], block: int = SILHOUETTE_BLOCK) -> DataFrame:
    """Mean Euclidean silhouette with its quality band; exact and quadratic, see :func:`moment_silhouette_score`."""
    return _overall(silhouettes(labelled, id, columns, block))


def moment_silhouettes(labelled: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """Silhouette of every point over squared distances; 0 for a point alone in its cluster.

    The mean squared distance of a point to a cluster is its squared distance to the cluster's mean plus the cluster's mean
    squared deviation, so counts, means and variances of the clusters say it all: one aggregate, then one pass over
    the points.  A row holds one entry per cluster, whose number is the caller's choice of k.
    """
    dims = list(columns)
    moments = labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.array(*[F.avg(d) for d in dims]).alias("centre"),
        reduce(Column.__add__, [F.var_pop(d) for d in dims]).alias("spread"),
    )
    known = moments.agg(F.collect_list(F.struct("cluster", "size", "centre", "spread"))).scalar()

    def squares(cluster: Column) -> Column:
        gaps = [F.col(d) - F.get(cluster["centre"], i) for i, d in enumerate(dims)]
        return reduce(Column.__add__, [g * g for g in gaps]) + cluster["spread"]

    own = F.get(F.filter("_clusters", lambda c: c["cluster"] == F.col("cluster")), 0)
    others = F.filter("_clusters", lambda c: c["cluster"] != F.col("cluster"))
    # the point itself is no neighbour of its own
    inside = squares(F.col("_own")) * F.col("_own.size") / (F.col("_own.size") - 1)
    named = labelled.select(id, "cluster", *dims, known.alias("_clusters")).withColumn("_own", own)
    wide = named.select(id, "cluster", "_own", F.when(F.col("_own.size") > 1, inside).alias("_inside"), F.array_min(F.transform(others, squares)).alias("_nearest"))
    width = F.try_divide(F.col("_nearest") - F.col("_inside"), F.greatest("_nearest", "_inside"))
    return wide.select(id, "cluster", F.when(F.col("_own.size") > 1, F.coalesce(width, F.lit(0.0))).otherwise(F.lit(0.0)).alias("silhouette"))


def moment_silhouette_score(labelled: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """Mean silhouette over squared distances with its quality band, at a cost linear in the points.

    Squaring stretches the gaps, so values lie above those of :func:`silhouette_score` on well separated clusters.
    """
    return _overall(moment_silhouettes(labelled, id, columns))


def _cluster_word(metric: Column) -> Column:
    upper = F.upper(metric)
    word = None
    for texts, label in rules.CLUSTER_WORDS:
        hit = F.lit(False)
        for text in texts:
            hit = hit | upper.contains(text)
        word = F.when(hit, label) if word is None else word.when(hit, label)
    return word.otherwise(F.split(F.trim(metric), r"\s+")[0])


def metric_z(matrix: Matrix, labels: DataFrame, spread: str) -> DataFrame:
    """Cluster mean of each metric as z against all entities; ``spread`` is ``std_samp`` or ``std_pop``."""
    z = (F.col("_mean") - F.col("mean")) / (F.col(spread) + F.lit(1e-8))
    return (
        matrix.long()
        .join(labels.select(matrix.id, "cluster"), matrix.id)
        .groupBy("cluster", "metric")
        .agg(F.avg("value").alias("_mean"))
        .join(matrix.statistics(), "metric")
        .select("cluster", "metric", F.col("_mean").alias("cluster_mean"), z.alias("z"))
    )


def _extremes(z: DataFrame, n: int) -> DataFrame:
    per_cluster = W.partitionBy("cluster")
    return z.withColumns(
        {
            "_high": F.row_number().over(per_cluster.orderBy(F.desc("z"), "metric")),
            "_low": F.row_number().over(per_cluster.orderBy("z", "metric")),
        }
    )


def cluster_insights(matrix: Matrix, labels: DataFrame, n: int = 3) -> DataFrame:
    """Name, size, leading and trailing metrics (sample std) and mean z of every cluster.

    A cluster collects at most one entry per metric.
    """
    ranked = _extremes(metric_z(matrix, labels, "std_samp"), n)

    def picked(rank: str) -> Column:
        entry = F.struct(F.col(rank).alias("rank"), "metric", "z")
        return F.array_sort(F.collect_list(F.when(F.col(rank) <= n, entry)))

    words = F.array_distinct(F.transform(F.slice(F.col("strengths"), 1, 2), lambda s: _cluster_word(s["metric"])))
    return (
        ranked.groupBy("cluster")
        .agg(picked("_high").alias("strengths"), picked("_low").alias("weaknesses"), F.avg("z").alias("avg_z"))
        .join(cluster_sizes(labels), "cluster")
        .withColumn("name", F.concat(F.lit("High "), F.array_join(words, "/")))
        .select("cluster", "name", "size", "strengths", "weaknesses", "avg_z")
    )


def cluster_characteristics(matrix: Matrix, labels: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest and lowest metrics per cluster on population z, in long form."""
    sides = F.array_compact(
        F.array(
            F.when(F.col("_high") <= n, F.struct(F.lit("strength").alias("kind"), F.col("_high").alias("rank"))),
            F.when(F.col("_low") <= n, F.struct(F.lit("weakness").alias("kind"), F.col("_low").alias("rank"))),
        )
    )
    ranked = _extremes(metric_z(matrix, labels, "std_pop"), n)
    return ranked.select("cluster", "metric", "cluster_mean", "z", F.inline(sides))


@dataclass(frozen=True)
class ComponentAnalysis:
    """Result of :func:`component_analysis`."""

    matrix: Matrix
    spectrum: Spectrum
    suitability: Suitability
    n_kaiser: int
    n_parallel: int
    n_components: int
    scores: DataFrame
    loadings: DataFrame


def component_analysis(
    measures: DataFrame, metrics: Sequence[str] | DataFrame, entities: Sequence | DataFrame | None = None
) -> ComponentAnalysis:
    """Pivot, impute, drop constant metrics, standardise, and keep the components that beat chance."""
    spark = measures.sparkSession
    names = listed(metrics)
    matrix = complete_matrix(selected_means(measures, names, entities), metrics=names).varying()
    r = matrix.correlation()
    found = spectrum(matrix, r)
    thresholds = parallel_thresholds(spark, matrix.n, len(matrix.metrics))
    k = component_count(found, thresholds)
    return ComponentAnalysis(
        matrix,
        found,
        suitability(r, matrix.n),
        kaiser_count(found),
        parallel_count(found, thresholds),
        k,
        scores(matrix, found, k),
        loadings(spark, matrix, found, k),
    )


def cluster_entities(analysis: ComponentAnalysis, k: int = 3) -> DataFrame:
    """Scores with a cluster each, found on the first three components."""
    columns = [c for c in analysis.scores.columns if c.startswith("PC")][:3]
    return kmeans_labels(analysis.scores, "entity", columns, min(k, analysis.matrix.n))


def exported(analysis: ComponentAnalysis, k: int = 3) -> DataFrame:
    return export_table(cluster_entities(analysis, k))


#: Covered metrics, and entities, that an analysis takes at least.
LEAST_COVERED = 3


@dataclass(frozen=True)
class GatedAnalysis:
    """Result of :func:`gated_analysis`; without enough data only ``status`` is set (see :func:`gate`)."""

    status: str
    matrix: Matrix | None = None
    spectrum: Spectrum | None = None
    labelled: DataFrame | None = None
    score: DataFrame | None = None


def covered_metrics(means: DataFrame, asked: int) -> DataFrame:
    """Metrics that at least half of the ``asked`` entities, and three, have a mean for."""
    return (
        means.groupBy("metric")
        .agg(F.count(F.lit(1)).alias("entities"))
        .where(F.col("entities") >= max(3, asked * 0.5))
    )


def _asked(measures: DataFrame, entities: Sequence | DataFrame | None) -> int:
    if entities is None:
        return measures.where("entity is not null").select("entity").distinct().count()
    return entities.select("entity").distinct().count() if isinstance(entities, DataFrame) else len(entities)


def _gate_status(metrics: int, entities: int) -> str:
    return "too_few_metrics" if metrics < LEAST_COVERED else "too_few_entities" if entities < LEAST_COVERED else "ok"


def gate(
    measures: DataFrame, metrics: Sequence[str] | DataFrame, entities: Sequence | DataFrame | None = None
) -> DataFrame:
    """One row: ``status`` (ok, too_few_metrics, too_few_entities), covered ``metrics`` and ``entities`` with a mean."""
    means = settle(selected_means(measures, listed(metrics), entities))
    n_metrics = covered_metrics(means, _asked(measures, entities)).count()
    n_entities = means.select("entity").distinct().count()
    row = (_gate_status(n_metrics, n_entities), n_metrics, n_entities)
    return measures.sparkSession.createDataFrame([row], "status string, metrics long, entities long")


def gated_analysis(
    measures: DataFrame, metrics: Sequence[str] | DataFrame, k: int = 3, entities: Sequence | DataFrame | None = None
) -> GatedAnalysis:
    """Components and clusters on metrics that at least half of the entities (and three) have.

    ``score`` is the linear :func:`moment_silhouette_score`; for the exact, quadratic one call :func:`silhouette_score`.
    """
    means = settle(selected_means(measures, listed(metrics), entities))
    kept = means.select("entity").distinct()
    valid = listed(covered_metrics(means, _asked(measures, entities)))
    n = kept.count()
    if (status := _gate_status(len(valid), n)) != "ok":
        return GatedAnalysis(status)
    matrix = complete_matrix(means.where(F.col("metric").isin(valid)), kept, valid)
    found = spectrum(matrix)
    size = min(3, len(valid), n)
    columns = [f"PC{j + 1}" for j in range(size)]
    labelled = kmeans_labels(scores(matrix, found, size), "entity", columns, min(k, n))
    return GatedAnalysis("ok", matrix, found, labelled, moment_silhouette_score(labelled, "entity", columns))
