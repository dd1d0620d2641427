"""Closed forms of the F distributions that fits need, and error metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import safe_div


def f_cdf_1_5(f: Column) -> Column:
    t = F.atan(F.sqrt(f / 5.0))
    return F.lit(2 / math.pi) * (t + F.sin(t) * (F.cos(t) + F.lit(2.0 / 3.0) * F.pow(F.cos(t), F.lit(3.0))))


def f_tail_1(f: Column, d: Column) -> Column:
    """P(F(1, d) > f) for a whole number d >= 1: the tails of Student's t, whose series over cosines ends."""
    angle = F.atan(F.sqrt(f / d))
    odd = d % 2 == 1
    # terms 1, 1/2 cos^2, 1*3/(2*4) cos^4 ... for even d, and cos, 2/3 cos^3, 2*4/(3*5) cos^5 ... for odd d
    steps = F.when(d > 3, F.sequence(F.lit(1), F.floor((d - 2) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    ratio = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k)) * F.cos(angle) * F.cos(angle)
    start = F.struct(first.alias("term"), first.alias("sum"))
    step = lambda s, k: F.struct((s["term"] * ratio(k)).alias("term"), (s["sum"] + s["term"] * ratio(k)).alias("sum"))
    series = F.sin(angle) * F.aggregate(steps, start, step)["sum"]
    inside = F.when(d == 1, 2 / math.pi * angle).when(odd, 2 / math.pi * (angle + series)).otherwise(series)
    return 1.0 - inside


def f_cdf_3_3(f: Column) -> Column:
    x = f / (1.0 + f)
    return F.lit(2 / math.pi) * (F.asin(F.sqrt(x)) - F.sqrt(x * (1.0 - x)) * (1.0 - 2.0 * x))


def bias(y: Column, p: Column) -> Column:
    return F.avg(p - y)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(safe_div(p - y, y))) * 100


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST, of the pairs without a NULL."""
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    return 1 - safe_div(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))
