"""Null-safe building blocks. Inside the engine a missing value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def fill_to_null(c: Column, fills: tuple = (), above: float | None = None) -> Column:
    """NULL for NaN, the given fill values and anything over `above`."""
    bad = F.isnan(c)
    if fills:
        bad = bad | c.isin(*fills)
    if above is not None:
        bad = bad | (c > above)
    return F.when(F.coalesce(bad, F.lit(False)), None).otherwise(c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip(c: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounds a value; NULL stays NULL (greatest and least alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def true(c: Column) -> Column:
    """A condition as plain true or false: NULL counts as false."""
    return F.coalesce(c, F.lit(False))


def member(c: Column, values) -> Column:
    """Membership in which NULL is never a member."""
    return true(c.isin(*values))
