"""Load-velocity work: features per athlete, power loads, training zones and force-velocity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import percent
from ..functions.samples import merged_mean, merged_variance, moment_columns, with_grand_mean
from .sessions import SESSION, known_clients

GRAVITY = 9.81
FEATURES = ["max_speed", "avg_speed", "best_split", "consistency", "retention"]
# fixed values of the weekly plan
WEEKLY_PLAN = [
    ("Monday", "Power", "optimal_load", "6 x 3", "3-4 min"),
    ("Wednesday", "Speed", "speed_zone_high", "4 x 4", "2-3 min"),
    ("Friday", "Strength", "strength_zone_low", "5 x 3", "4-5 min"),
]


def _first_weight() -> list[Column]:
    """Body weight on the earliest rep as ``first_weight``, and ``first_key`` to merge it by.

    Reps of one instant are ordered by load, then by weight (missing ones first), so that the answer does not depend on
    how rows are laid out.
    """
    key = F.struct("rep_ts", "load", "weight")
    return [F.min(key).alias("first_key"), F.min(key)["weight"].alias("first_weight")]


def load_stats(sprints: DataFrame) -> DataFrame:
    """One row per client and load; every per-athlete load figure derives from it."""
    return (
        known_clients(sprints)
        .groupBy("client", "load")
        .agg(
            F.max("top_speed").alias("max_speed"),
            F.min("split_5").alias("best_split"),
            F.avg("max_accel").alias("mean_accel"),
            *_first_weight(),
            *moment_columns("top_speed", "speed"),
        )
    )


def _retention() -> Column:
    """Best speed at the heaviest load relative to the lightest, in percent (rows are loads)."""
    loaded = F.col("load").isNotNull()
    heaviest = F.max_by("max_speed", F.when(loaded, F.col("load")))
    lightest = F.min_by("max_speed", F.when(loaded, F.col("load")))
    return percent(heaviest, lightest)


def retention_profile(retention: Column) -> Column:
    return F.when(
        retention.isNotNull(),
        F.when(retention > 65, "Force-Dominant").when(retention > 50, "Balanced").otherwise("Velocity-Dominant"),
    )


def athlete_features(sprints: DataFrame) -> DataFrame:
    """Speed, split, consistency (sample std) and load retention per client, missing values left NULL.

    ``profile`` reads the retention and stays NULL for clients with a single load.  The mean speed is joined back
    to the loads instead of taken by a window: a client may have any number of loads.
    """
    by_load = load_stats(sprints)
    features = (
        with_grand_mean(by_load, "speed", ["client"])
        .groupBy("client")
        .agg(
            F.max("max_speed").alias("max_speed"),
            merged_mean("speed").alias("avg_speed"),
            F.min("best_split").alias("best_split"),
            F.sqrt(merged_variance("speed")).alias("consistency"),
            F.count("load").alias("loads_tested"),
            _retention().alias("_retention"),
        )
    )
    several = F.col("loads_tested") > 1
    return features.withColumns(
        {
            "retention": F.when(several, F.col("_retention")).otherwise(F.lit(100.0)),
            "profile": F.when(several, retention_profile(F.col("_retention"))),
        }
    ).drop("_retention")


def fill_with_means(features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Missing features take the column mean, read by scalar subqueries."""
    means = features.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m"))
    mean_of = means.scalar()
    return features.withColumns({c: F.coalesce(F.col(c), mean_of[c]) for c in columns})


def load_velocity_curve(sprints: DataFrame) -> DataFrame:
    """Line through the best speed per load; clients with at least two loads."""
    curve = (
        load_stats(sprints)
        .where("load is not null")
        .groupBy("client")
        .agg(
            F.count(F.lit(1)).alias("loads_tested"),
            F.regr_slope("max_speed", "load").alias("slope"),
            F.regr_intercept("max_speed", "load").alias("intercept"),
            F.min_by("max_speed", "load").alias("speed_at_min_load"),
            _retention().alias("retention"),
        )
        .where("loads_tested >= 2")
    )
    return curve.withColumn("profile", retention_profile(F.col("retention")))


def load_power(sprints: DataFrame) -> DataFrame:
    """Mean speed, mean acceleration and estimated power per client and load.

    The body weight is the one on the client's earliest rep (of several, the one of the lightest load, then weight).
    """
    by_load = load_stats(sprints)
    weights = by_load.groupBy("client").agg(F.min_by("first_weight", "first_key").alias("weight"))
    power = (F.col("weight") + F.col("load")) * F.col("mean_accel") * F.col("mean_speed")
    return (
        by_load.where("load is not null")
        .join(weights, "client")
        .select("client", "load", "weight", F.col("speed_mean").alias("mean_speed"), "mean_accel")
        .withColumn("power", power)
    )


def optimal_power(sprints: DataFrame) -> DataFrame:
    """Load of highest power (the lightest among equals) with the range of loads tested."""
    ranking = F.when(F.col("power").isNotNull(), F.struct("power", -F.col("load")))
    return (
        load_power(sprints)
        .groupBy("client")
        .agg(
            F.max_by("load", ranking).alias("optimal_load"),
            F.max("power").alias("max_power"),
            F.count(F.lit(1)).alias("loads_tested"),
            F.min("load").alias("min_load"),
            F.max("load").alias("max_load"),
        )
        .where("optimal_load is not null")
    )


def training_zones(power: DataFrame) -> DataFrame:
    """Speed, power and strength load ranges from :func:`optimal_power`."""
    low, high, best = F.col("min_load"), F.col("max_load"), F.col("optimal_load")
    third = low + (high - low) / 3.0
    return power.withColumns(
        {
            "speed_zone_low": low,
            "speed_zone_high": F.greatest(F.least(third, best * 0.7), low + 1.0),
            "power_zone_low": F.greatest(best * 0.8, low),
            "power_zone_high": F.least(best * 1.2, high),
            "strength_zone_low": F.least(best * 1.3, high - 5.0),
            "strength_zone_high": high,
        }
    )


def weekly_plan(zones: DataFrame) -> DataFrame:
    rows = [
        F.struct(
            F.lit(day).alias("day"),
            F.lit(focus).alias("focus"),
            F.rint(F.col(load)).cast("int").alias("load_kg"),
            F.lit(sets).alias("sets"),
            F.lit(rest).alias("rest"),
        )
        for day, focus, load, sets, rest in WEEKLY_PLAN
    ]
    return zones.select("client", F.inline(F.array(*rows)))


def session_loads(sprints: DataFrame) -> DataFrame:
    """Best speed per (client, session, load)."""
    return (
        known_clients(sprints)
        .groupBy(*SESSION, "load")
        .agg(
            F.max("top_speed").alias("max_speed"),
            F.count(F.lit(1)).alias("sprints"),
            *_first_weight(),
        )
    )


def _session_fits(sprints: DataFrame) -> DataFrame:
    """Line through the best speed per load of every session, whatever its slope."""
    return (
        session_loads(sprints)
        .groupBy(*SESSION)
        .agg(
            F.count("load").alias("n_points"),
            F.sum("sprints").alias("n_sprints"),
            F.min("load").alias("_low"),
            F.max("load").alias("_high"),
            F.regr_slope("max_speed", "load").alias("slope"),
            F.regr_intercept("max_speed", "load").alias("v0"),
            F.regr_r2("max_speed", "load").alias("r_squared"),
            F.min_by("first_weight", "first_key").alias("weight"),
        )
    )


def _falling_profiles(fits: DataFrame) -> DataFrame:
    v0, f0, slope = F.col("v0"), F.col("f0_load"), F.col("slope")
    return (
        fits.where("n_points >= 2 and slope < 0")
        .withColumn("f0_load", F.try_divide(-v0, slope))
        .withColumn("f0_newtons", (F.col("weight") + f0) * GRAVITY)
        .withColumn("pmax", F.col("f0_newtons") * v0 / 4.0)
        .select(*SESSION, "v0", "f0_load", "f0_newtons", "pmax", "slope", "r_squared", "weight", "n_points")
    )


def force_velocity_profiles(sprints: DataFrame) -> DataFrame:
    """Force-velocity profile of every session with two loads and a falling line."""
    return _falling_profiles(_session_fits(sprints))


def profile_sessions(sprints: DataFrame, min_loads: int = 2) -> DataFrame:
    """Sessions with at least ``min_loads`` distinct loads."""
    span = F.concat(
        F.rint("_low").cast("int").cast("string"),
        F.lit("-"),
        F.rint("_high").cast("int").cast("string"),
        F.lit(" kg"),
    )
    return (
        _session_fits(sprints)
        .where(F.col("n_points") >= min_loads)
        .select(*SESSION, F.col("n_points").alias("n_loads"), "n_sprints", span.alias("load_range"))
    )


def profile_shift(sprints: DataFrame, sessions: int = 3) -> DataFrame:
    """First against last valid profile among each client's first ``sessions`` sessions with two loads."""
    order = W.partitionBy("client").orderBy("session_date")
    chosen = (
        _session_fits(sprints)
        .where("n_points >= 2")
        .withColumn("_k", F.row_number().over(order))
        .where(F.col("_k") <= sessions)
    )
    measures = ["v0", "f0_newtons", "pmax"]
    ends = []
    for name in measures:
        ends += [
            F.min_by(name, "session_date").alias(f"_first_{name}"),
            F.max_by(name, "session_date").alias(f"_last_{name}"),
        ]
    pairs = (
        _falling_profiles(chosen)
        .groupBy("client")
        .agg(
            F.count(F.lit(1)).alias("profiles"),
            F.min("session_date").alias("first_date"),
            F.max("session_date").alias("last_date"),
            *ends,
        )
        .where("profiles >= 2")
    )
    changes = {}
    for name, short in zip(measures, ["v0", "f0", "pmax"], strict=True):
        delta = F.col(f"_last_{name}") - F.col(f"_first_{name}")
        changes[f"{short}_change"] = delta
        changes[f"{short}_change_pct"] = percent(delta, F.col(f"_first_{name}"))
    v0, f0, pmax = (F.col(f"{m}_change_pct") for m in ("v0", "f0", "pmax"))
    # fixed texts of the shift report
    notes = F.array_compact(
        F.array(
            F.when(v0 > 3, F.lit("Velocity capability improved")),
            F.when(f0 > 3, F.lit("Force capability improved")),
            F.when(pmax > 5, F.lit("Power output increased")),
            F.when((v0 < -3) | (f0 < -3), F.lit("Performance declining")),
        )
    )
    shift = (
        F.when((v0 > 2) & (f0 > 2), "Overall Improvement")
        .when(v0 > 2, "Velocity Shift")
        .when(f0 > 2, "Force Shift")
        .when((v0 < -2) | (f0 < -2), "Declining")
        .otherwise("Stable")
    )
    return (
        pairs.withColumns(changes)
        .withColumns({"shift": shift, "notes": notes})
        .select("client", "first_date", "last_date", "profiles", *changes, "shift", "notes")
    )
