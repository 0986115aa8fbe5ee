"""Null-safe arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def finite(col: Column) -> Column:
    """NaN and both infinities become NULL; Spark aggregates skip NULL but not NaN."""
    unusable = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~unusable, col)


def finite_columns(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({name: finite(F.col(f"`{name}`")) for name in floats}) if floats else df


def to_number(col: Column) -> Column:
    """Text to double, bad text and non-finite text to NULL.

    A type suffix (``1d``, ``1f``) is not a number here although the cast would accept it.
    """
    return F.when(~col.rlike("[dDfF]\\s*$"), finite(col.try_cast("double")))


def half_even(col: Column, digits: int) -> Column:
    """Round half to even on the scaled value."""
    scale = 10.0**digits
    return F.rint(col * scale) / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, NULL when the denominator is zero."""
    return F.try_divide(part, whole) * 100.0


def cv_percent(std: Column, mean: Column) -> Column:
    return percent(std, mean)


def band(col: Column, steps: list[tuple[float, str]], top: str) -> Column:
    """Label by ascending exclusive upper bounds: ``col < bound`` picks the first that holds."""
    (bound, label), *rest = steps
    picked = F.when(col < bound, label)
    for bound, label in rest:
        picked = picked.when(col < bound, label)
    return F.when(col.isNotNull(), picked.otherwise(top))


def bind(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` planned once; repeating a large expression inline multiplies the plan."""
    return F.transform(F.array(col), use)[0]
