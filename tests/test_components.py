from __future__ import annotations

import numpy as np
import pytest
from helpers import by, measures, sprint, sprints
from pyspark.sql import functions as F

from motionlake.operators import clusters, components, matrix, sprint_clusters

METRICS = [f"m{i}" for i in range(5)]


@pytest.fixture(scope="module")
def table():
    """30 entities in three groups, five metrics, with holes and one constant metric."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 5)) + np.repeat([[0, 0, 0, 0, 0], [6, 6, 0, 0, 0], [-6, 6, 0, 0, 0]], 10, axis=0)
    x[:, 2] = x[:, 0] * 2 + rng.normal(size=30) * 0.1
    x[4, 1] = x[20, 3] = x[21, 3] = np.nan
    return x


@pytest.fixture(scope="module")
def long(spark, table):
    rows = [(f"e{i:02d}", f"m{j}", v + d, k) for (i, j), v in np.ndenumerate(table) if not np.isnan(v) for k, d in enumerate((0.5, -0.5))]
    rows += [(f"e{i:02d}", "constant", 4, 0) for i in range(30)] + [("e00", "void", None, 0)]
    return measures(spark, rows)


@pytest.fixture(scope="module")
def analysis(long):
    return clusters.component_analysis(long, [*METRICS, "constant", "void"])


def filled(table):
    out = table.copy()
    for j in range(out.shape[1]):
        out[np.isnan(out[:, j]), j] = np.nanmedian(out[:, j])
    return out


def test_matrix(table, analysis):
    m, want = analysis.matrix, filled(table)
    assert m.metrics == METRICS  # the constant and the empty metric are gone
    rows = by(m.rows, "entity")
    got = np.array([[rows[f"e{i:02d}"][c] for c in METRICS] for i in range(30)])
    assert got == pytest.approx(want)
    assert m.mean == pytest.approx(want.mean(axis=0)) and m.std_pop == pytest.approx(want.std(axis=0))
    assert m.std_samp == pytest.approx(want.std(axis=0, ddof=1))
    assert m.correlation() == pytest.approx(np.corrcoef(want, rowvar=False))
    z = by(m.standardized(), "entity")
    assert z["e03"]["m1"] == pytest.approx((want[3, 1] - want[:, 1].mean()) / want[:, 1].std())


def test_spectrum_and_scores(table, analysis):
    want = filled(table)
    z = (want - want.mean(axis=0)) / want.std(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    found = analysis.spectrum
    assert found.eigenvalues == pytest.approx(s**2 / 29)
    assert found.eigenvalues.sum() == pytest.approx(5 * 30 / 29)
    assert found.ratios.sum() == pytest.approx(1)
    assert np.abs(found.components) == pytest.approx(np.abs(vt), abs=1e-9)
    assert (found.components[np.arange(5), np.abs(found.components).argmax(axis=1)] > 0).all()
    k = analysis.n_components
    rows = by(analysis.scores, "entity")
    got = np.array([[rows[f"e{i:02d}"][f"PC{j + 1}"] for j in range(k)] for i in range(30)])
    assert got == pytest.approx(z @ found.components[:k].T)
    assert np.corrcoef(got, rowvar=False) == pytest.approx(np.eye(k), abs=1e-9)
    assert k == max(2, min(analysis.n_kaiser, analysis.n_parallel))


def test_suitability(analysis):
    r = analysis.matrix.correlation()
    found = components.suitability(r, 30)
    inverse = np.linalg.inv(r)
    d = np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(5, dtype=bool)
    plain, partial = (r[off] ** 2).sum(), ((inverse / d)[off] ** 2).sum()
    assert found.kmo == pytest.approx(plain / (plain + partial), abs=1e-3)
    assert found.bartlett_chi2 == pytest.approx(-(29 - 15 / 6) * np.log(np.linalg.det(r)), abs=0.06)
    assert found.bartlett_dof == 10 and found.bartlett_p < 1e-6
    assert components.suitability(np.full((3, 3), np.nan), 5) == components.Suitability()
    least = components.suitability(np.ones((3, 3)), 30)  # singular: the least determinant stands for 0
    assert least.bartlett_chi2 == pytest.approx((29 - 11 / 6) * 300 * np.log(10), abs=0.06) and 0 <= least.kmo <= 1


def test_parallel_thresholds(spark):
    drawn = components.parallel_thresholds(spark, 40, 4)
    assert drawn == pytest.approx(components.parallel_thresholds(spark, 40, 4))  # seeded
    rng = np.random.default_rng(0)
    sims = [np.linalg.eigvalsh(np.corrcoef(rng.normal(size=(40, 4)), rowvar=False))[::-1] for _ in range(400)]
    assert drawn == pytest.approx(np.percentile(sims, 95, axis=0), abs=0.12)
    assert len(components.parallel_thresholds(spark, 5, 8, iterations=10)) == 8
    short = components.Spectrum(np.array([3.0, 1.5, 0.5]), np.ones(3) / 3, np.eye(3), 3)
    assert components.parallel_count(short, np.ones(8)) == components.kaiser_count(short) == 2


def test_loading_tables(spark, analysis):
    table = components.loadings(spark, analysis.matrix, analysis.spectrum, 2)
    s = analysis.spectrum
    importance = {r.metric: r.importance for r in components.feature_importance(table).collect()}
    want = (np.abs(s.components[:2]) * s.ratios[:2, None]).sum(axis=0)
    assert [importance[m] for m in METRICS] == pytest.approx(want)
    top = components.top_loadings(table, n=3).collect()
    assert sorted(r["rank"] for r in top) == [1, 1, 2, 2, 3, 3]
    assert all((r.contribution is None) == (abs(r.loading) <= 0.3) for r in top)
    variance = components.variance_table(spark, s, 5).collect()
    assert variance[-1].cumulative == pytest.approx(1)
    plot = components.biplot(analysis.scores, "entity", table, n=2).collect()
    points = [r for r in plot if r.kind == "score"]
    assert len(points) == 30 and max(max(abs(r.x), abs(r.y)) for r in points) == pytest.approx(1)
    assert len(plot) == 32


def brute_silhouette(x, labels):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(labels):
        same = [j for j in range(len(x)) if labels[j] == own and j != i]
        if not same:
            out.append(0.0)
            continue
        a = gaps[i, same].mean()
        b = min(gaps[i, labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_clusters_and_silhouette(spark, analysis, long):
    labelled = clusters.cluster_entities(analysis, 3)
    rows = sorted(labelled.collect(), key=lambda r: r.entity)
    labels = np.array([r.cluster for r in rows])
    columns = [c for c in labelled.columns if c.startswith("PC")][:3]
    x = np.array([[r[c] for c in columns] for r in rows])
    firsts = [int(np.argmax(labels == c)) for c in range(3)]
    assert firsts == sorted(firsts) and firsts[0] == 0  # numbered by the smallest entity

    def cost(groups):
        return sum(((x[groups == c] - x[groups == c].mean(axis=0)) ** 2).sum() for c in range(3))

    centers = np.array([x[labels == c].mean(axis=0) for c in range(3)])
    nearest = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == labels).all() and cost(labels) <= cost(np.repeat([0, 1, 2], 10)) + 1e-9
    want = brute_silhouette(x, labels)
    for block in (1024, 7):
        got = by(clusters.silhouettes(labelled, "entity", columns, block), "entity")
        assert [got[r.entity]["silhouette"] for r in rows] == pytest.approx(want)
    score = clusters.silhouette_score(labelled, "entity", columns).first()
    assert score.silhouette == pytest.approx(want.mean())
    sizes = {r.cluster: r["size"] for r in clusters.cluster_sizes(labelled).collect()}
    assert sizes == {c: int((labels == c).sum()) for c in range(3)}
    exported = by(components.export_table(labelled.drop("PC3")), "entity")
    assert exported["e00"]["cluster"] == 1 and (exported["e00"]["PC3"] == 0 or len(columns) < 3)
    assert exported["e05"]["PC1"] == pytest.approx(x[5, 0], abs=1e-4)


def test_silhouette_edges(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("b", 0, 1.0), ("c", 1, 5.0)], "entity string, cluster int, PC1 double")
    got = by(clusters.silhouettes(df, "entity", ["PC1"]), "entity")
    assert got["c"]["silhouette"] == 0 and got["a"]["silhouette"] == pytest.approx(0.8)
    same = df.withColumn("cluster", F.lit(0))
    row = clusters.silhouette_score(same, "entity", ["PC1"]).first()
    assert row.silhouette is None and row.quality is None


def test_cluster_descriptions(spark, table, analysis):
    labels = analysis.matrix.rows.select("entity", F.floor(F.substring("entity", 2, 2).cast("int") / 10).cast("int").alias("cluster"))
    want = filled(table)
    insights = by(clusters.cluster_insights(analysis.matrix, labels), "cluster")
    z = (want[10:20].mean(axis=0) - want.mean(axis=0)) / (want.std(axis=0, ddof=1) + 1e-8)
    order = np.argsort(-z)
    assert [s["metric"] for s in insights[1]["strengths"]] == [f"m{j}" for j in order[:3]]
    assert insights[1]["strengths"][0]["z"] == pytest.approx(z[order[0]])
    assert [s["metric"] for s in insights[1]["weaknesses"]] == [f"m{j}" for j in order[::-1][:3]]
    assert insights[1]["avg_z"] == pytest.approx(z.mean()) and insights[1]["size"] == 10
    assert insights[1]["name"] == "High " + "/".join(f"m{j}" for j in order[:2])
    rows = clusters.cluster_characteristics(analysis.matrix, labels).where("cluster = 1 and kind = 'strength' and rank = 1").first()
    assert rows.z == pytest.approx((want[10:20].mean(axis=0) - want.mean(axis=0))[order[0]] / (want[:, order[0]].std() + 1e-8))


def test_gated_analysis(spark, long):
    few = clusters.gated_analysis(long.where("metric in ('m0', 'm1')"), ["m0", "m1", "m2"])
    assert few.status == "too_few_metrics" and few.labelled is None
    closed = clusters.gate(long.where("metric in ('m0', 'm1')"), ["m0", "m1", "m2"])
    assert [tuple(r) for r in closed.collect()] == [("too_few_metrics", 2, 30)]
    pair = measures(spark, [(e, m, 1, 0) for e in "ab" for m in METRICS])
    assert clusters.gated_analysis(pair, METRICS).status == "too_few_metrics"
    sparse = long.where("metric <> 'm4' or entity < 'e10'")  # ten of thirty entities: below half
    ok = clusters.gated_analysis(sparse, METRICS, k=3)
    assert ok.status == "ok" and ok.matrix.metrics == ["m0", "m1", "m2", "m3"]
    assert ok.labelled.count() == 30 and ok.score.first().silhouette > 0.3


def test_capped_correlations(analysis):
    kept = matrix.correlation_pairs(analysis.matrix, max_metrics=2)
    widest = sorted(zip(-analysis.matrix.std_samp, METRICS, strict=True))[:2]
    assert {r.metric_a for r in kept.collect()} == {m for _, m in widest}
    assert [r.r for r in kept.where("metric_a = metric_b").collect()] == pytest.approx([1.0, 1.0])


def test_too_many_metrics_is_an_error(spark):
    with pytest.raises(ValueError, match="metrics"):
        matrix.listed([f"m{i}" for i in range(matrix.MAX_METRICS + 1)])


def test_sprint_clusters(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12):
        base = 6 + 4 * (i % 2)
        for j in range(6):
            rows.append(sprint(f"c{i:02d}", day=j, rep=j, speed=base + rng.normal() * 0.1, load=10 * (j % 3), split=2.0 - base / 10))
    df = sprint_clusters.cluster_athletes(sprints(spark, rows), k=2)
    got = by(df, "client")
    assert {c: r["cluster"] for c, r in got.items()} == {f"c{i:02d}": i % 2 for i in range(12)}
    summary = by(sprint_clusters.cluster_summary(df), "cluster")
    assert summary[0]["members"] == 6 and summary[1]["avg_max_speed"] > summary[0]["avg_max_speed"]


def test_moment_silhouette_is_the_silhouette_of_squared_distances(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (20, 2)), rng.normal(6, 1, (15, 2)), [[100.0, 100.0]], np.full((3, 2), 1e6)]
    label = [0] * 20 + [1] * 15 + [2] + [3] * 3
    df = spark.createDataFrame([(i, int(c), *map(float, p)) for i, (c, p) in enumerate(zip(label, x, strict=True))], "id long, cluster int, x double, y double")
    squares = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    got = {r.id: r.silhouette for r in clusters.moment_silhouettes(df, "id", ["x", "y"]).collect()}
    for i, c in enumerate(label):
        same = [j for j, d in enumerate(label) if d == c and j != i]
        if not same:
            assert got[i] == 0
            continue
        a = squares[i, same].mean()
        b = min(squares[i, [j for j, d in enumerate(label) if d == e]].mean() for e in set(label) - {c})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    one = clusters.moment_silhouette_score(df.where("cluster = 0"), "id", ["x", "y"]).first()
    assert one.silhouette is None and one.clusters == 1
    plan = clusters.moment_silhouette_score(df, "id", ["x", "y"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan


def test_restarts_move_together_and_find_the_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (30, 2)), rng.normal((0, 9), 0.3, (30, 2))]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double").repartition(5)
    got = {r.id: r.cluster for r in clusters.kmeans_labels(df, "id", ["x", "y"], 3).collect()}
    assert [got[i] for i in range(100)] == [0] * 40 + [1] * 30 + [2] * 30
    one = [np.array([[0.0, 0.0], [5.0, 5.0]]), np.array([[0.0, 9.0]])]
    sums = clusters.restart_sums(df, ["x", "y"], one)
    assert [list(s["n"]) for s in sums.values()] == [[(((x - 0) ** 2).sum(1) <= ((x - 5) ** 2).sum(1)).sum(), (((x - 0) ** 2).sum(1) > ((x - 5) ** 2).sum(1)).sum()], [100]]
    assert sums[1]["cost"].sum() == pytest.approx(((x - [0, 9]) ** 2).sum()) and sums[1]["s0"].sum() == pytest.approx(x[:, 0].sum())


def test_kmeans_with_few_points(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 7.0)], "id long, x double")
    assert [r.cluster for r in clusters.kmeans_labels(df, "id", ["x"], 3).orderBy("id").collect()] == [0, 0, 1]
    assert clusters.kmeans_labels(df.limit(0), "id", ["x"], 2).count() == 0
    with pytest.raises(Exception, match="value in every column"):
        clusters.kmeans_labels(spark.createDataFrame([(1, 2.0), (2, None)], "id long, x double"), "id", ["x"], 1)


def test_means_travel_once_to_the_matrix(spark, long, table):
    """F4, F9, F11 to F21: means were grouped by entity and metric, written as long rows, and grouped twice more to pivot them."""
    asked = [*METRICS, "constant", "void"]
    means = matrix.selected_means(long, asked)
    plan = matrix.pivoted(means, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    known, found = matrix.complete_matrix(means, metrics=asked), matrix.complete_matrix(means)
    assert known.metrics == found.metrics == sorted([*METRICS, "constant"]) and known.n == found.n == 30
    for a, b in ((known.mean, found.mean), (known.std_pop, found.std_pop), (known.std_samp, found.std_samp)):
        assert a == pytest.approx(b)
    assert by(known.rows, "entity") == by(found.rows, "entity")
    assert [r["m1"] for r in known.rows.orderBy("entity").collect()] == pytest.approx(filled(table)[:, 1])
    more = spark.createDataFrame([("e00",), ("new",)], "entity string")
    wider = matrix.complete_matrix(means, more, asked)
    assert wider.n == 31 and by(wider.rows, "entity")["new"]["m1"] == pytest.approx(np.nanmedian(table[:, 1]))


def test_small_blocks_do_not_multiply(spark):
    """60,000 points in blocks of 24 made 2,500 blocks and three million pairs of them."""
    assert clusters.silhouette_blocks(60_000, 24) == clusters.silhouette_blocks(360_000, 24) == clusters.SILHOUETTE_BLOCKS
    assert clusters.silhouette_blocks(100, 24) == 5 and clusters.silhouette_blocks(0, 24) == 1
    assert clusters.silhouette_blocks(10**6, clusters.SILHOUETTE_BLOCK) == clusters.silhouette_blocks(10**6, 24) == 62
