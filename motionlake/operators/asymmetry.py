"""Left/right asymmetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import band, percent
from .sessions import SESSION, known_clients

# metric -> True when smaller is better
SIDE_METRICS = {"top_speed": False, "max_accel": False, "split_5": True}


def side_gap(left: Column, right: Column) -> Column:
    """Unsigned gap relative to the better side, in percent."""
    both = left.isNotNull() & right.isNotNull()
    return F.when(both, percent(F.abs(left - right), F.greatest(left, right)))


def side_index(left: Column, right: Column) -> Column:
    """Signed index relative to the mean of both sides; positive when left is larger, 0 without a positive mean."""
    mean = (left + right) / 2.0
    return F.when(mean > 0, percent(left - right, mean)).when(mean.isNotNull(), F.lit(0.0))


def side_risk(gap: Column) -> Column:
    return band(gap, [(5, "Low"), (10, "Moderate")], "High")


def _of_side(side: str, col) -> Column:
    return F.when(F.col("side") == side, col)


def _sided(sprints: DataFrame) -> DataFrame:
    return known_clients(sprints).where(F.col("side").isin("Left", "Right"))


def simple_asymmetry(sprints: DataFrame) -> DataFrame:
    """Best speed and acceleration by side per client; clients with rows on both sides."""
    columns = []
    for side in ("Left", "Right"):
        short = side.lower()
        columns += [
            F.max(_of_side(side, F.col("top_speed"))).alias(f"{short}_speed"),
            F.max(_of_side(side, F.col("max_accel"))).alias(f"{short}_accel"),
            F.count_if(F.col("side") == side).alias(f"_{short}"),
        ]
    return (
        _sided(sprints)
        .groupBy("client")
        .agg(*columns)
        .where("_left > 0 and _right > 0")
        .withColumns(
            {
                "speed_asymmetry": side_gap(F.col("left_speed"), F.col("right_speed")),
                "accel_asymmetry": side_gap(F.col("left_accel"), F.col("right_accel")),
            }
        )
        .withColumn("risk_level", side_risk(F.col("speed_asymmetry")))
        .drop("_left", "_right")
    )


def sided_athletes(sprints: DataFrame) -> DataFrame:
    """Clients with both Left and Right rows."""
    return (
        _sided(sprints)
        .groupBy("client")
        .agg(F.min("side").alias("_a"), F.max("side").alias("_b"))
        .where("_a <> _b")
        .select("client")
    )


def signed_asymmetry(sprints: DataFrame, by: Sequence[str] = ("client",)) -> DataFrame:
    """Signed index per metric in long form; ``by`` may add ``session_date`` for one row set per session."""
    by = list(by)
    columns = [F.count_if(F.col("side") == side).alias(f"{side.lower()}_count") for side in ("Left", "Right")]
    for metric, lower_is_better in SIDE_METRICS.items():
        best = F.min if lower_is_better else F.max
        columns += [
            best(_of_side("Left", F.col(metric))).alias(f"_left_{metric}"),
            best(_of_side("Right", F.col(metric))).alias(f"_right_{metric}"),
        ]
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"_left_{metric}").alias("left_value"),
            F.col(f"_right_{metric}").alias("right_value"),
            F.lit(-1.0 if lower_is_better else 1.0).alias("_sign"),
        )
        for metric, lower_is_better in SIDE_METRICS.items()
    ]
    index = F.col("asymmetry")
    return (
        _sided(sprints)
        .groupBy(*by)
        .agg(*columns)
        .where("left_count > 0 and right_count > 0")
        .select(*by, "left_count", "right_count", F.inline(F.array(*rows)))
        .where("left_value is not null and right_value is not null")
        .withColumn("asymmetry", F.col("_sign") * side_index(F.col("left_value"), F.col("right_value")))
        .withColumn("abs_asymmetry", F.abs(index))
        .withColumns(
            {
                "risk": side_risk(F.col("abs_asymmetry")),
                "dominant": F.when(index > 0, "Left").when(index < 0, "Right").otherwise("Balanced"),
            }
        )
        .drop("_sign")
    )


def asymmetry_trend(sprints: DataFrame) -> DataFrame:
    """Speed and acceleration asymmetry of every session with speeds on both sides."""

    def of(metric: str, col: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(col)))

    return (
        signed_asymmetry(sprints, SESSION)
        .groupBy(*SESSION)
        .agg(
            of("top_speed", "abs_asymmetry").alias("speed_asymmetry"),
            of("top_speed", "dominant").alias("speed_dominant"),
            of("max_accel", "abs_asymmetry").alias("accel_asymmetry"),
            of("top_speed", "left_value").alias("left_speed"),
            of("top_speed", "right_value").alias("right_speed"),
        )
        .where("speed_asymmetry is not null")
    )


def load_matched_asymmetry(sprints: DataFrame, by: Sequence[str] = ("client",)) -> DataFrame:
    """Signed speed index at every load present on both sides."""
    return (
        _sided(sprints)
        .where("load is not null")
        .groupBy(*by, "load")
        .agg(
            F.max(_of_side("Left", F.col("top_speed"))).alias("left_speed"),
            F.max(_of_side("Right", F.col("top_speed"))).alias("right_speed"),
        )
        .where("left_speed is not null and right_speed is not null")
        .withColumn("asymmetry", side_index(F.col("left_speed"), F.col("right_speed")))
        .withColumn("abs_asymmetry", F.abs("asymmetry"))
        .withColumn("risk", side_risk(F.col("abs_asymmetry")))
    )


def asymmetry_direction(trend: DataFrame) -> DataFrame:
    """Change of speed asymmetry from first to last session; clients with at least three sessions."""
    change = F.col("change")
    return (
        trend.groupBy("client")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.min_by("speed_asymmetry", "session_date").alias("first_value"),
            F.max_by("speed_asymmetry", "session_date").alias("last_value"),
        )
        .where("sessions >= 3")
        .withColumn("change", F.col("last_value") - F.col("first_value"))
        .withColumn("direction", F.when(change < -2, "improving").when(change > 2, "worsening").otherwise("stable"))
    )


def action_tier(signed: DataFrame) -> DataFrame:
    """Tier from the largest asymmetry over the metrics of :func:`signed_asymmetry`."""
    worst = F.col("max_asymmetry")
    return (
        signed.groupBy("client")
        .agg(F.max("abs_asymmetry").alias("max_asymmetry"))
        .withColumn("tier", F.when(worst > 10, "high").when(worst > 5, "moderate").otherwise("low"))
    )
