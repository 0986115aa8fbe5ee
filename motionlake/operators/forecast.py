"""Smoothed speed forecast per athlete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sessions import SESSION, known_clients

ALPHA = 0.3
RECENT = 5
HORIZONS = (7, 14, 30)


def speed_forecast(sprints: DataFrame) -> DataFrame:
    """Exponentially weighted daily best speed, its recent slope and damped predictions.

    The recursion e_i = a x_i + (1-a) e_(i-1), e_1 = x_1 is a weighted sum, so the last five smoothed values are
    plain conditional sums over the days of a client (one row per date, ranked from the latest).
    """
    per_client = W.partitionBy("client")
    daily = (
        known_clients(sprints)
        .groupBy(*SESSION)
        .agg(F.max("top_speed").alias("speed"))
        .withColumns(
            {
                "back": F.row_number().over(per_client.orderBy(F.desc("session_date"))) - 1,
                "dates": F.count(F.lit(1)).over(per_client),
                "day": F.datediff("session_date", F.min("session_date").over(per_client)).cast("double"),
            }
        )
        .where("dates >= 3")
    )
    weight = F.when(F.col("back") == F.col("dates") - 1, 1.0).otherwise(ALPHA)

    def smoothed(k: int):
        age = F.col("back") - k
        return F.sum(F.when(age >= 0, weight * F.pow(F.lit(1 - ALPHA), age) * F.col("speed")))

    points = daily.groupBy("client").agg(
        F.max("dates").alias("dates"),
        F.max(F.when(F.col("back") == 0, F.col("speed"))).alias("current_speed"),
        F.stddev_pop(F.when(F.col("back") < RECENT, F.col("speed"))).alias("speed_std"),
        F.array(
            *[
                F.struct(
                    F.max(F.when(F.col("back") == k, F.col("day"))).alias("day"), smoothed(k).alias("ewma")
                )
                for k in range(RECENT)
            ]
        ).alias("recent"),
    )
    fitted = (
        points.select("client", "dates", "current_speed", "speed_std", F.col("recent")[0]["ewma"].alias("smoothed_speed"), F.inline("recent"))
        .groupBy("client", "dates", "current_speed", "speed_std", "smoothed_speed")
        .agg(F.regr_slope("ewma", "day").alias("trend_rate"))
    )
    now, rate, std = F.col("smoothed_speed"), F.col("trend_rate"), F.col("speed_std")

    def predicted(days: int):
        raw = now + rate * float(days) * (1.0 - days / 100.0)
        return F.least(F.greatest(raw, F.col("current_speed") * 0.95), F.col("current_speed") * 1.05)

    consistency = F.when(std < 0.1, "high").when(std < 0.2, "moderate").otherwise("low")
    trend = F.when(rate > 0.002, "Improving").when(rate < -0.002, "Declining").otherwise("Stable")
    confidence = (
        F.when(F.col("consistency") == "high", "High")
        .when(F.col("trend") == "Stable", "Low")
        .otherwise("Moderate")
    )
    return (
        fitted.withColumns({f"predicted_{d}d": predicted(d) for d in HORIZONS})
        .withColumns({"consistency": consistency, "trend": trend})
        .withColumn("confidence", confidence)
        .drop("speed_std", "dates")
    )
