"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(col: Column) -> Column:
    """Round to the six decimals at which results are compared."""
    return F.round(col, 6)


def ratio(num: Column, den: Column) -> Column:
    """Null instead of an error when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def is_finite(col: Column) -> Column:
    col = col.cast("double")
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))
