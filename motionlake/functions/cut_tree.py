"""A tree of cuts over numeric columns, built and searched as Spark jobs.

Cells are cut at quantiles of their widest dimension until none holds more than a given number of rows.  Each node carries
the box around its rows.  Searching walks all queries down the levels together: a level is one join of the queries still
open with the children of the nodes they reached, and a box out of reach ends the walk there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Cuts of a cell at a level, and the precision of the quantile sketch.
CUTS = 7
ACCURACY = 1000

ROOT = 0


#: A level of at most so many nodes (some 5 MB) is broadcast; larger ones have many keys and are joined by them.
BROADCAST_NODES = 50_000


@dataclass(frozen=True)
class CutTree:
    """``rows`` with the ``cell`` each lies in and the box of the node above it (``outer_low_<dim>, outer_high_<dim>``,
    NULL for the root); per level the nodes ``parent, node, n, leaf, low_<dim>, high_<dim>`` and their number."""

    rows: DataFrame
    levels: list[tuple[DataFrame, int]]
    dims: list[str]


def _get(columns: Sequence[Column], place: Column) -> Column:
    return F.get(F.array(*columns), place)


def build(rows: DataFrame, dims: Sequence[str], most: int) -> CutTree:
    """Cut ``rows`` (finite ``dims``, no two rows equal in all of them) into cells of at most ``most`` rows.

    A level cuts every larger cell at ``CUTS`` quantiles of its widest dimension, or at the middle of its box where all
    quantiles are the box's upper side.  Either leaves rows on both sides, so each level makes the open cells smaller.  A level
    is one aggregate by cell and one join of the rows still open; there are about log(rows / most) levels.
    """
    dims, names = list(dims), rows.columns
    boxes = [f"{side}_{d}" for d in dims for side in ("low", "high")]
    shares = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    root = F.lit(ROOT).cast("long")
    open_rows = settle(rows.withColumns({"parent": root, "cell": root}))
    done, levels, above = [], [], None
    while True:
        nodes = settle(
            open_rows.groupBy("parent", "cell").agg(
                F.count(F.lit(1)).alias("n"),
                *[f(d).alias(f"{side}_{d}") for d in dims for side, f in (("low", F.min), ("high", F.max))],
                *[F.percentile_approx(d, shares, ACCURACY).alias(f"cuts_{d}") for d in dims],
            )
        )
        levels.append((nodes.select("parent", F.col("cell").alias("node"), "n", (F.col("n") <= most).alias("leaf"), *boxes), nodes.count()))
        leaves = nodes.where(F.col("n") <= most).select("cell", "parent")
        if above is None:
            leaves = leaves.select("cell", *[F.lit(None).cast("double").alias(f"outer_{b}") for b in boxes])
        else:
            leaves = leaves.join(above, "parent").select("cell", *[f"outer_{b}" for b in boxes])
        done.append(open_rows.join(leaves, "cell").select(*names, "cell", *[f"outer_{b}" for b in boxes]))
        large = nodes.where(F.col("n") > most)
        if large.isEmpty():
            return CutTree(reduce(DataFrame.union, done), levels, dims)
        above = large.select(F.col("cell").alias("parent"), *[F.col(b).alias(f"outer_{b}") for b in boxes])
        widths = [F.struct((F.col(f"high_{d}") - F.col(f"low_{d}")).alias("width"), F.lit(i).alias("dim")) for i, d in enumerate(dims)]
        large = large.withColumn("_dim", F.greatest(*widths)["dim"])
        low, high = (_get([F.col(f"{side}_{d}") for d in dims], F.col("_dim")) for side in ("low", "high"))
        inner = F.filter(F.array_distinct(_get([F.col(f"cuts_{d}") for d in dims], F.col("_dim"))), lambda c: c < high)
        cuts = F.when(F.size(inner) > 0, inner).otherwise(F.array(low / 2 + high / 2))
        cut = large.select("cell", "_dim", cuts.alias("_cuts"))
        value = _get([F.col(d) for d in dims], F.col("_dim"))
        child = F.xxhash64("cell", F.size(F.filter("_cuts", lambda c: c < value)))
        open_rows = settle(open_rows.join(cut, "cell").select(*names, F.col("cell").alias("parent"), child.alias("cell")))


def within_reach(tree: CutTree, queries: DataFrame, radius: str) -> DataFrame:
    """``queries`` with each leaf ``cell`` whose box lies no farther than ``radius`` (a column of ``queries``)."""

    def gap(d: str) -> Column:
        return F.greatest(F.col(f"low_{d}") - F.col(d), F.col(d) - F.col(f"high_{d}"), F.lit(0.0))

    near = reduce(Column.__add__, [gap(d) * gap(d) for d in tree.dims]) <= F.col(radius) * F.col(radius)
    names, found = queries.columns, []
    walking = queries.withColumn("_at", F.lit(ROOT).cast("long"))
    for depth, (nodes, n) in enumerate(tree.levels):
        nodes = F.broadcast(nodes) if n <= BROADCAST_NODES else nodes
        reached = walking.join(nodes, F.col("_at") == F.col("parent" if depth else "node")).where(near)
        reached = settle(reached.select(*names, "node", "leaf"))
        found.append(reached.where("leaf").select(*names, F.col("node").alias("cell")))
        walking = reached.where(~F.col("leaf")).select(*names, F.col("node").alias("_at"))
    return reduce(DataFrame.union, found)
