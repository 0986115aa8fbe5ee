"""Two-sample statistics from (count, mean, variance), and exact merging of such summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import bind
from .tails import student_t_two_sided


def pooled_std(n1: Column, v1: Column, n2: Column, v2: Column) -> Column:
    """Weighted pooled standard deviation; NULL unless both samples have two values."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    both = (n1 > 1) & (n2 > 1)
    return F.when(both, F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)))


def cohen_d(n1, m1, v1, n2, m2, v2) -> Column:
    """(mean2 - mean1) / pooled SD, 0 when the pooled SD is 0."""
    return bind(
        pooled_std(n1, v1, n2, v2),
        lambda sd: F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(m2 - m1, sd)),
    )


def t_test_p(n1, m1, v1, n2, m2, v2) -> Column:
    """Equal-variance two-sided p-value; without spread it is 0 for different means, NULL for equal."""
    weights = F.try_divide(F.lit(1.0), n1.cast("double")) + F.try_divide(F.lit(1.0), n2.cast("double"))

    def p_value(sd: Column) -> Column:
        t = F.try_divide(m1 - m2, sd * F.sqrt(weights))
        return F.when((sd == 0) & (m1 != m2), F.lit(0.0)).otherwise(student_t_two_sided(t, n1 + n2 - 2))

    return bind(pooled_std(n1, v1, n2, v2), p_value)


def moment_columns(value: str, prefix: str) -> list[Column]:
    """Count, mean and centred sum of squares of one group, mergeable by :func:`merged`."""
    v = F.col(value)
    return [
        F.count(v).alias(f"{prefix}_n"),
        F.avg(v).alias(f"{prefix}_mean"),
        (F.var_pop(v) * F.count(v)).alias(f"{prefix}_m2"),
    ]


def _about_grand(prefix: str, grand: Column) -> dict[str, Column]:
    n, mean, m2 = (F.col(f"{prefix}_{s}") for s in ("n", "mean", "m2"))
    return {f"{prefix}_grand": grand, f"{prefix}_m2_part": m2 + n * (mean - grand) * (mean - grand)}


def merged(prefix: str, window) -> dict[str, Column]:
    """Per-part columns whose plain sums over ``window``'s keys give the moments of the union.

    ``*_grand`` is the mean of the union and ``*_m2_part`` the part's centred squares about it, so no
    large squares are subtracted.  Only for parts that are few per key, such as days.
    """
    n, mean = F.col(f"{prefix}_n"), F.col(f"{prefix}_mean")
    return _about_grand(prefix, F.try_divide(F.sum(n * mean).over(window), F.sum(n).over(window)))


def with_grand_mean(parts: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """The columns of :func:`merged` by a join on the keys, for any number of parts per key."""
    n, mean = F.col(f"{prefix}_n"), F.col(f"{prefix}_mean")
    grand = parts.groupBy(*keys).agg(F.try_divide(F.sum(n * mean), F.sum(n)).alias("_grand"))
    return parts.join(grand, keys).withColumns(_about_grand(prefix, F.col("_grand"))).drop("_grand")


def merged_mean(prefix: str) -> Column:
    return F.first(f"{prefix}_grand", ignorenulls=True)


def merged_variance(prefix: str) -> Column:
    n = F.sum(f"{prefix}_n")
    return F.when(n > 1, F.try_divide(F.sum(f"{prefix}_m2_part"), n - 1))
