"""Most similar athletes, for one athlete and for every athlete."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cut_tree
from ..session import settle

SIMILARITY_METRICS = ["max_speed", "avg_speed", "best_split"]
BLOCK = 2000
VISITORS = 50_000
CHUNK = 256


def similarity(squared_distance):
    """100 for equal athletes, falling with the distance per metric."""
    return 100.0 / (1.0 + F.sqrt(squared_distance) / F.lit(len(SIMILARITY_METRICS) ** 0.5))


def similar_athletes(features: DataFrame, target, top_n: int = 3) -> DataFrame:
    """The ``top_n`` athletes closest to ``target``: one pass over the feature table and a top-k.

    The target's metrics enter as a scalar subquery, so no join is planned.
    """
    wanted = (
        features.where(F.col("client") == F.lit(target))
        .select(F.struct(*SIMILARITY_METRICS).alias("t"))
        .scalar()
    )
    squares = sum(((wanted[m] - F.col(m)) * (wanted[m] - F.col(m)) for m in SIMILARITY_METRICS), F.lit(0.0))
    return (
        features.where(F.col("client") != F.lit(target))
        .select("client", similarity(squares).alias("similarity"), "max_speed", "best_split")
        .orderBy(F.desc_nulls_last("similarity"), "client")
        .limit(top_n)
    )


def similar_to_each(features: DataFrame, top_n: int = 3, block: int = BLOCK, visitors: int = VISITORS) -> DataFrame:
    """The ``top_n`` closest athletes of every athlete.  Exact, without pairing everyone.

    A similarity with a missing metric on either side is NULL and comes last, in order of the partners' names, as in
    :func:`similar_athletes`.

    1. Athletes with equal metrics share one spot that names its ``top_n + 1`` first athletes; more of them can
       never be needed.
    2. A tree of cuts over all metrics deals the spots to cells of at most ``block``.  Inside its cell a spot finds a
       radius that holds enough athletes; the tree names the cells whose boxes lie within it.
    3. A spot visits those cells; cells with many visitors are met by ``visitors`` at a time.
    """
    dims = SIMILARITY_METRICS
    need = top_n + 1

    # local functions travel to the workers with the tasks, which then need not import this package
    def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        gaps = x[:, None, :] - y[None, :, :]
        return (gaps * gaps).sum(axis=2)

    def chunks(n: int, size: int = CHUNK) -> list[slice]:
        return [slice(i, i + size) for i in range(0, n, size)]

    features = settle(features.select("client", *dims))
    complete = features.dropna()
    kind = complete.schema["client"].dataType.simpleString()
    first = F.row_number().over(W.partitionBy(*dims).orderBy("client"))
    spots = settle(
        complete.withColumn("_k", first)
        .where(F.col("_k") <= need)
        .groupBy(*dims)
        .agg(F.array_sort(F.collect_list("client")).alias("clients"))
    )
    tree = cut_tree.build(spots, dims, max(block, need))
    placed = settle(tree.rows)
    sides = [[f"outer_{side}_{d}" for d in dims] for side in ("low", "high")]

    def reach(spots_of_cell: pd.DataFrame) -> pd.DataFrame:
        x = spots_of_cell[dims].to_numpy(float)
        if len(x) >= need:
            radius = np.empty(len(x))
            for part in chunks(len(x)):
                radius[part] = np.sqrt(np.partition(squared(x[part], x), need - 1, axis=1)[:, need - 1])
        else:  # the node above holds enough athletes: no farther than the farthest corner of its box
            low, high = (spots_of_cell[side].to_numpy(float) for side in sides)
            radius = np.nan_to_num(np.sqrt((np.maximum(x - low, high - x) ** 2).sum(axis=1)), nan=np.inf)
        # a hair wider than measured, so that rounding cannot hide an equally distant athlete
        return spots_of_cell[dims].assign(radius=radius * (1 + 1e-9) + 1e-12)

    typed = ", ".join(f"{d} double" for d in dims)
    reaches = settle(placed.drop("clients").groupBy("cell").applyInPandas(reach, f"{typed}, radius double"))
    visits = settle(cut_tree.within_reach(tree, reaches, "radius").drop("radius"))
    placed = placed.select(*dims, "clients", "cell")
    turns = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / visitors).cast("int").alias("_turns"))
    guests = visits.join(turns, "cell").withColumn("turn", F.pmod(F.hash(*dims), F.col("_turns"))).drop("_turns")
    hosts = placed.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1))).drop("_turns")

    def nearest(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        athletes = host.explode("clients").sort_values("clients", kind="stable")
        names, y, x = athletes["clients"].to_numpy(), athletes[dims].to_numpy(float), guest[dims].to_numpy(float)
        out = []
        for part in chunks(len(x)) if len(names) else []:
            squares = squared(x[part], y)
            # columns are in name order, so a stable sort breaks ties by name
            best = np.argsort(squares, axis=1, kind="stable")[:, :need]
            rows = np.repeat(np.arange(len(best)), best.shape[1])
            picked = best.ravel()
            found = guest.iloc[part][dims].iloc[rows].reset_index(drop=True)
            found["partner"], found["squares"] = names[picked], squares[rows, picked]
            found["s_max_speed"], found["s_best_split"] = y[picked, 0], y[picked, 2]
            out.append(found)
        columns = [*dims, "partner", "squares", "s_max_speed", "s_best_split"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    by_distance = [F.col("squares"), F.col("partner")]
    candidates = (
        guests.groupBy("cell", "turn")
        .cogroup(hosts.groupBy("cell", "turn"))
        .applyInPandas(nearest, f"{typed}, partner {kind}, squares double, s_max_speed double, s_best_split double")
        .withColumn("_k", F.row_number().over(W.partitionBy(*dims).orderBy(*by_distance)))
        .where(F.col("_k") <= need)
        .drop("_k")
    )
    measured = (
        complete.join(candidates, dims)
        .where("client <> partner")
        .withColumn("rank", F.row_number().over(W.partitionBy("client").orderBy(*by_distance)))
        .where(F.col("rank") <= top_n)
        .select(
            "client",
            "rank",
            "partner",
            similarity(F.col("squares")).alias("similarity"),
            F.col("s_max_speed").alias("max_speed"),
            F.col("s_best_split").alias("best_split"),
        )
    )
    return measured.union(_unmeasured(features, top_n))


def _unmeasured(features: DataFrame, top_n: int) -> DataFrame:
    """Rows with NULL similarity: all partners of an athlete without some metric, and the last ones of other athletes
    where fewer than ``top_n`` others have all metrics.  Only the first few names of either kind can be partners."""
    whole = F.lit(True)
    for m in SIMILARITY_METRICS:
        whole = whole & F.col(m).isNotNull()

    def first_names(rows: DataFrame, n: int) -> Column:
        partner = F.struct(F.col("client").alias("partner"), "max_speed", "best_split")
        return rows.orderBy("client").limit(n).agg(F.array_sort(F.collect_list(partner)).alias("p")).scalar()

    others = features.where(whole).agg((F.count(F.lit(1)) - 1).cast("int")).scalar()
    known = features.select(
        "client", whole.alias("_whole"), others.alias("_others"), first_names(features, top_n + 1).alias("_anyone"),
        first_names(features.where(~whole), top_n).alias("_gaps"),
    )
    own = F.slice(F.filter("_anyone", lambda x: x["partner"] != F.col("client")), 1, top_n)
    rest = F.slice("_gaps", F.lit(1), F.greatest(F.lit(0), F.lit(top_n) - F.col("_others")))
    before = F.when(F.col("_whole"), F.col("_others")).otherwise(F.lit(0))
    partners = F.posexplode(F.when(F.col("_whole"), rest).otherwise(own)).alias("_i", "_p")
    return known.select("client", before.alias("_before"), partners).select(
        "client",
        (F.col("_before") + F.col("_i") + 1).cast("int").alias("rank"),
        F.col("_p.partner").alias("partner"),
        F.lit(None).cast("double").alias("similarity"),
        F.col("_p.max_speed").alias("max_speed"),
        F.col("_p.best_split").alias("best_split"),
    )
