"""Floating-point semantics that Spark's defaults don't have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """a / b in doubles: dividing by zero gives an infinity, or NaN for 0 / 0, in place of an error or null."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).when(b == 0, at_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def less(a: Column, b: Column) -> Column:
    """a < b, false if either is NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def larger(a: Column, b: Column) -> Column:
    """The larger of two doubles, ignoring NaN."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def finite(a: Column) -> Column:
    return a.isNotNull() & ~F.isnan(a) & (F.abs(a) != F.lit(float("inf")))
