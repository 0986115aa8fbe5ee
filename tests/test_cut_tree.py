"""The tree of cuts: bounded cells, exact reach, and work that follows the number of rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from motionlake.functions import cut_tree
from motionlake.operators import similarity

DIMS = ["x", "y", "z"]


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "id long, x double, y double, z double")


def shapes():
    r = random.Random(4)
    cube = [[r.random() for _ in range(3)] for _ in range(400)]
    tied = [[5.0, 5.0, i / 300] for i in range(300)] + [[5.0, 6.0, 0.0], [9.0, 5.0, 0.0]]
    tail = [[10.0 ** (i / 8), i % 3, 0.0] for i in range(200)]
    return {"cube": cube, "tied": tied, "tail": tail, "one": [[1.0, 2.0, 3.0]], "none": []}


@pytest.mark.parametrize("shape", list(shapes()))
def test_cells_are_bounded_and_reach_is_exact(spark, shape):
    rows = shapes()[shape]
    tree = cut_tree.build(points(spark, rows), DIMS, 10)
    cells = {}
    for r in tree.rows.collect():
        cells.setdefault(r.cell, []).append((r.x, r.y, r.z))
    assert sum(map(len, cells.values())) == len(rows) and all(len(c) <= 10 for c in cells.values())
    queries = points(spark, rows[::7]).withColumn("radius", F.lit(0.2))
    got = {(r.id, r.cell) for r in cut_tree.within_reach(tree, queries, "radius").collect()}
    for i, q in enumerate(rows[::7]):
        for cell, members in cells.items():
            gaps = [max(min(m[d] for m in members) - q[d], q[d] - max(m[d] for m in members), 0.0) for d in range(3)]
            assert ((i, cell) in got) == (math.hypot(*gaps) <= 0.2)


def test_levels_and_visits_follow_the_logarithm(spark):
    """Ten times the points: a level or two more, and no more cells visited by each."""

    def visits(n):
        df = spark.range(n).select(F.col("id"), *[F.rand(seed).alias(d) for seed, d in enumerate(DIMS)])
        tree = cut_tree.build(df, DIMS, 100)
        # a ball that holds about five points
        queries = tree.rows.select("id", *DIMS, F.lit((5 / n / 4.19) ** (1 / 3)).alias("radius"))
        return cut_tree.within_reach(tree, queries, "radius").count() / n, len(tree.levels)

    (few, low), (many, high) = visits(4_000), visits(40_000)
    assert many < few * 1.4 and high <= low + 2


def test_similarity_with_outliers_and_ties(spark):
    """Cells with fewer athletes than are asked for look no farther than the node above."""
    r = random.Random(8)
    rows = [(f"c{i:03d}", 7.0, 6.0, round(r.random(), 3)) for i in range(150)] + [(f"d{i}", 7.0 + 10.0**i, 6.0, 0.5) for i in range(6)]
    df = spark.createDataFrame(rows, "client string, max_speed double, avg_speed double, best_split double")
    got = {}
    for g in similarity.similar_to_each(df, 3, block=6, visitors=30).orderBy("client", "rank").collect():
        got.setdefault(g.client, []).append(g.partner)
    for c, *x in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), d) for d, *y in rows if d != c)[:3]
        assert got[c] == [d for _, d in near], c
