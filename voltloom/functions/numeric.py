"""Null-aware arithmetic on columns. ANSI mode raises on ``x / 0``, so nothing here divides bare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAPE_FLOOR = 1e-8  # fixed value: |y| and sMAPE denominators at or below this are left out


def clean(c: Column) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def clip(c: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; null stays null (``greatest`` alone would drop it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def ratio_to_infinity(a: Column, b: Column) -> Column:
    """a / b with IEEE results at zero: signed infinity, and null for 0 / 0."""
    return F.when(
        b == 0,
        F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))),
    ).otherwise(F.try_divide(a, b))


def percent_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, F.abs(before))
