"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, counted


def _pairs(edges: DataFrame, high, low) -> DataFrame:
    return edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct()


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges, seen = counted(edges, total=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    return edges, (seen["n"], seen["total"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: the smallest id reachable, for every id that has an edge to another.

    Large-star hangs each node's larger neighbours on its smallest neighbour, small-star its smaller ones; the forest gets
    flat in a logarithmic number of rounds.  Minima are taken in each task first and the joins on a node with many edges
    are split by adaptive execution.  Every round is written to the shared folder, in as many
    tasks as its rows ask for.  Edges with a null end are left out.
    """
    edges, state = _settled(_pairs(edges, F.greatest(a, b), F.least(a, b)))
    edges = compact(edges, state[0])
    while state[0]:
        n = state[0]
        both = edges.union(edges.select("v", "u"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # repeated rows fall away at the end of the round; there are no more of them than edges
        large = compact(both.join(smallest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").where("v <> m").select("v", "m")
        edges = _pairs(moved.union(compact(smallest.select("u", "m"), n)).toDF("x", "y"), F.col("x"), F.col("y"))
        before = state
        edges, state = _settled(compact(edges, 2 * n))
        if state == before:
            break
    roots = edges.select("v", "v")
    return edges.select("u", "v").union(roots).toDF("id", "component").distinct()
