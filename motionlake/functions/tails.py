"""Tail probabilities as Column expressions (no Python in the row path).

* Normal: the ascending series for small arguments, the continued fraction for the tail.
* Student t: the finite trigonometric series for integer degrees of freedom; above
  ``SERIES_MAX_DOF`` an asymptotic normal transform, so the cost per row is bounded no matter how many
  samples a group has.
* Chi-square: finite series on the driver; it is only needed for one scalar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import bind

SERIES_MAX_DOF = 200
_SERIES_TERMS = 45
_FRACTION_TERMS = 80
_SPLIT = 3.0


def _normal_upper(a: Column) -> Column:
    """P(Z > a) for a >= 0."""
    return bind(F.least(a, F.lit(38.0)), _normal_upper_bounded)


def _normal_upper_bounded(a: Column) -> Column:
    density = F.exp(-a * a / 2.0) / F.lit(math.sqrt(2.0 * math.pi))
    start = F.struct(a.alias("term"), a.alias("total"))

    def add_term(acc: Column, k: Column) -> Column:
        term = acc["term"] * a * a / (F.lit(2.0) * k + F.lit(1.0))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)), start, add_term, lambda acc: acc["total"]
    )
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_TERMS), F.lit(1), F.lit(-1)),
        a,
        lambda acc, k: a + F.try_divide(k.cast("double"), acc),
    )
    return F.when(a < _SPLIT, 0.5 - density * series).otherwise(F.try_divide(density, fraction))


def normal_cdf(z: Column) -> Column:
    def cdf(v: Column) -> Column:
        return bind(bind(F.abs(v), _normal_upper), lambda upper: F.when(v >= 0, 1.0 - upper).otherwise(upper))

    return bind(z, cdf)


def _t_series(t: Column, dof: Column) -> Column:
    """Two-sided p from the central probability A(t | dof)."""
    return bind(F.try_divide(dof, dof + t * t), lambda cos2: 1.0 - _t_central(t, dof, cos2))


def _t_central(t: Column, dof: Column, cos2: Column) -> Column:
    odd = (dof % 2).cast("double")
    steps = F.floor(dof / 2) - 1
    ks = F.when(steps >= 1, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(
        F.array().cast("array<bigint>")
    )
    first = F.when(odd == 1, F.sqrt(cos2)).otherwise(F.lit(1.0))

    def add_term(acc: Column, k: Column) -> Column:
        numerator = 2.0 * k - 1.0 + odd
        term = acc["term"] * cos2 * numerator / (numerator + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(
        ks, F.struct(first.alias("term"), first.alias("total")), add_term, lambda acc: acc["total"]
    )
    weighted = F.sqrt(1.0 - cos2) * total
    angle = F.atan(F.try_divide(t, F.sqrt(dof)))
    return (
        F.when(dof == 1, angle * (2.0 / math.pi))
        .when(odd == 1, (angle + weighted) * (2.0 / math.pi))
        .otherwise(weighted)
    )


def _t_asymptotic(t: Column, dof: Column) -> Column:
    a = dof - 0.5
    b = 48.0 * a * a

    def corrected(z: Column) -> Column:
        z2 = z * z
        first = F.try_divide(z * (z2 + 3.0), b)
        second = F.try_divide(
            z * (((4.0 * z2 + 33.0) * z2 + 240.0) * z2 + 855.0), 10.0 * b * (b + 0.8 * z2 * z2 + 100.0)
        )
        return z + first - second

    z = F.sqrt(a * F.log1p(F.try_divide(t * t, dof)))
    return 2.0 * _normal_upper(bind(z, corrected))


def student_t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p-value of ``t`` with integer ``dof`` >= 1; NULL otherwise."""

    def p_value(v: Column) -> Column:
        size, n = v["t"], v["dof"]
        p = F.when(n <= SERIES_MAX_DOF, _t_series(size, n)).otherwise(_t_asymptotic(size, n))
        return F.when(size.isNotNull() & (n >= 1), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))

    size = F.least(F.abs(t), F.lit(1e150))
    return bind(
        F.when(t.isNotNull(), F.struct(size.alias("t"), dof.cast("double").alias("dof"))), p_value
    )


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square with ``dof`` degrees of freedom > x)."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    shift = 0.5 if dof % 2 else 0.0
    total = math.erfc(math.sqrt(half)) if dof % 2 else 0.0
    for j in range(dof // 2):
        power = j + shift
        total += math.exp(-half + power * math.log(half) - math.lgamma(power + 1.0))
    return min(total, 1.0)
