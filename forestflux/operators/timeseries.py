"""Per-pixel series: lags, gap filling, regression and change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHANGE_F_THRESHOLD, CHANGE_P_THRESHOLD
from ..functions.nulls import clip, safe_div, true
from ..functions.stats import f_cdf_1_5, f_cdf_3_3, f_tail_1

CELL = ("iy", "ix")


def _order(keys, by="year"):
    return Window.partitionBy(*keys).orderBy(by)


def previous(c: str, keys=CELL, default=None) -> Column:
    return F.lag(c, 1, default).over(_order(keys))


def attribute_to_fire(df: DataFrame, burned: str = "burned", keys=CELL) -> DataFrame:
    """Adds is_fire: burned in this year or the year before in the series; NULL counts as not burned."""
    flag = F.coalesce(F.col(burned).cast("int"), F.lit(0))
    rows = df.withColumn("__b", flag)
    return rows.withColumn("is_fire", (F.col("__b") + previous("__b", keys, 0)) > 0).drop("__b")


def losses(df: DataFrame, pools: list[str], keys=CELL) -> DataFrame:
    """Previous minus current of each pool, so that losses are positive; the first year goes."""
    first = Window.partitionBy(*keys)
    out = df.withColumns({f"d_{p}": previous(p, keys) - F.col(p) for p in pools}).withColumn("__y", F.min("year").over(first))
    return out.where(F.col("year") > F.col("__y")).drop("__y")


def growth(df: DataFrame, value: str, keys=CELL) -> DataFrame:
    """Adds the change against the year before, and in per cent of it."""
    before = previous(value, keys)
    return df.withColumns({"change": F.col(value) - before, "change_pct": safe_div(F.col(value) - before, before) * 100})


def z_scores(df: DataFrame, value: str, keys=CELL) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("z", safe_div(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def fill_axis(df: DataFrame, value: str, keys: list[str], axis: str, max_gap: float | None = None) -> DataFrame:
    """Fills NULLs along one axis; between known points only if they are at most max_gap apart, where that is given.

    Between known points linearly; outside, along the line of the two nearest known points. A single known point spreads to its
    direct neighbours, which then make the line constant; a series without any stays NULL.
    """
    whole = Window.partitionBy(*keys)
    up = Window.partitionBy(*keys).orderBy(axis)
    before, after = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    rows = df.withColumn("__p", point).withColumns({"__n": F.count(value).over(whole), "__a": F.last("__p", True).over(before), "__b": F.first("__p", True).over(after)})
    full = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = Window.partitionBy(*keys).orderBy(F.col(axis).desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"__f1": F.nth_value("__p", 1, True).over(full), "__f2": F.nth_value("__p", 2, True).over(full), "__l1": F.nth_value("__p", 1, True).over(down), "__l2": F.nth_value("__p", 2, True).over(down)}
    rows = rows.withColumns(ends)
    t = F.col(axis).cast("double")
    line = lambda p, q: p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / F.nullif(q["t"] - p["t"], F.lit(0.0))
    a, b = F.col("__a"), F.col("__b")
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(F.col("__n") == 0, None)
        .when(F.col("__n") == 1, F.col("__f1.v"))
        .when(a.isNull(), line(F.col("__f1"), F.col("__f2")))
        .when(b.isNull(), line(F.col("__l2"), F.col("__l1")))
        .otherwise(line(a, b) if max_gap is None else F.when(b["t"] - a["t"] <= max_gap, line(a, b)))
    )
    return rows.withColumn(value, filled).drop("__p", "__n", "__a", "__b", *ends)


def fill_gaps(df: DataFrame, value: str) -> DataFrame:
    """Fills a (iy, ix, year) stack along years, then longitude, then latitude, and clips to the least and greatest value before."""
    bounds = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    out = fill_axis(df, value, ["iy", "ix"], "year")
    out = fill_axis(out, value, ["year", "iy"], "ix")
    out = fill_axis(out, value, ["year", "ix"], "iy")
    return out.join(F.broadcast(bounds)).withColumn(value, clip(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def linear_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, residual sum of squares and p-value per key; a single point has slope 0, its own value as the intercept and p 0.

    The p-value is that of the line against the mean; a line through all points that explains something has 0, two points have none.
    """
    one = F.count(F.lit(1)) == 1
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    slope, intercept = F.regr_slope(b, a), F.regr_intercept(b, a)
    rss = F.greatest(F.regr_syy(b, a) - safe_div(F.regr_sxy(b, a) * F.regr_sxy(b, a), F.regr_sxx(b, a)), F.lit(0.0))
    fits = df.groupBy(*keys).agg(
        F.when(one, 0.0).otherwise(slope).alias("slope"), F.when(one, F.avg(b)).otherwise(intercept).alias("intercept"), F.when(one, 0.0).otherwise(rss).alias("rss"),
        F.count(F.lit(1)).alias("n"), F.regr_syy(b, a).alias("__tss"),
    )
    left = (F.col("n") - 2).cast("int")
    ratio = _f_ratio(F.greatest(F.col("__tss") - F.col("rss"), F.lit(0.0)), F.col("rss") / left)
    p = F.when(F.col("n") == 1, 0.0).when(left >= 1, F.when(ratio == float("inf"), 0.0).otherwise(f_tail_1(ratio, left)))
    return fits.withColumn("pvalue", p).drop("__tss")


def _fit(v: Column, low: int, high: int) -> tuple[Column, Column, Column]:
    """Line through points low..high-1 of the array, over their numbers: slope, intercept, residuals' sum of squares."""
    n = high - low
    ys = [F.get(v, F.lit(i)) for i in range(low, high)]
    mean = sum(ys[1:], ys[0]) / F.lit(float(n))
    if n == 1:
        return F.lit(0.0), mean, F.lit(0.0)
    centre = sum(range(low, high)) / n
    sxx = sum((i - centre) ** 2 for i in range(low, high))
    sxy = None
    for i, y in zip(range(low, high), ys):
        term = F.lit(i - centre) * (y - mean)
        sxy = term if sxy is None else sxy + term
    slope = sxy / F.lit(sxx)
    intercept = mean - slope * F.lit(centre)
    return slope, intercept, None


def _rss(v: Column, low: int, high: int, slope: str, intercept: str) -> Column:
    out = None
    for i in range(low, high):
        e = F.col(intercept) + F.col(slope) * F.lit(float(i)) - F.get(v, F.lit(i))
        out = e * e if out is None else out + e * e
    return out


def _f_ratio(a: Column, b: Column) -> Column:
    """a / b; a perfect fit (b is 0) is infinitely better if there was anything to explain, else unknown."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, F.lit(float("inf")))


def _p_value(f: Column, cdf) -> Column:
    return F.when(f == float("inf"), 0.0).otherwise(1.0 - cdf(f))


def change_points(df: DataFrame, value: str = "agb", keys=CELL, f_threshold: float = CHANGE_F_THRESHOLD, p_threshold: float = CHANGE_P_THRESHOLD, strict: bool = True) -> DataFrame:
    """Break detection in series of exactly seven yearly values; any other length is an error, or left out if not strict. So are series with a NULL left out.

    For every break 1..6 a line is fitted to each side; the break with the greatest F against the single line wins, the earliest of
    equals, and counts if F exceeds the threshold. The p-value compares the chosen model with the mean, and the prediction is that
    model where it is significant, else the mean. One row per key: breakpoint (NULL if none), max_f, pvalue, prediction (array).
    """
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", F.col(value).cast("double").alias("v")))).alias("s"))
    seven = F.size("s") == 7
    series = series.withColumn("s", F.when(seven, F.col("s")).otherwise(F.raise_error(F.lit("a series is not of seven years")))) if strict else series.where(seven)
    series = series.withColumn("v", F.transform("s", lambda p: p["v"])).where(~F.exists("v", lambda x: x.isNull())).drop("s")
    v = F.col("v")
    pieces = [(0, 7), *[(0, k) for k in range(1, 7)], *[(k, 7) for k in range(1, 7)]]
    fits = {}
    for a, b in pieces:
        slope, intercept, _ = _fit(v, a, b)
        fits |= {f"m{a}{b}": slope, f"c{a}{b}": intercept}
    mean = sum((F.get(v, F.lit(i)) for i in range(1, 7)), F.get(v, F.lit(0))) / F.lit(7.0)
    rows = series.withColumns(fits | {"mean": mean})
    rows = rows.withColumns({f"r{a}{b}": F.lit(0.0) if b - a == 1 else _rss(v, a, b, f"m{a}{b}", f"c{a}{b}") for a, b in pieces})
    total = None
    for i in range(7):
        e = F.get(v, F.lit(i)) - F.col("mean")
        total = e * e if total is None else total + e * e
    rows = rows.withColumn("tss", total)
    both = {f"b{k}": F.col(f"r0{k}") + F.col(f"r{k}7") for k in range(1, 7)}
    rows = rows.withColumns(both)
    # two lines (4 parameters) against one (2)
    f = {f"f{k}": _f_ratio((F.col("r07") - F.col(f"b{k}")) / 2.0, F.col(f"b{k}") / 3.0) for k in range(1, 7)}
    rows = rows.withColumns(f)
    rows = rows.withColumn("max_f", F.greatest(*[F.col(f"f{k}") for k in range(1, 7)]))
    where = F.coalesce(*[F.when(F.col(f"f{k}") == F.col("max_f"), F.lit(k)) for k in range(1, 7)])
    rows = rows.withColumn("breakpoint", F.when(true(F.col("max_f") > f_threshold), where))
    best = F.coalesce(*[F.when(F.col("breakpoint") == k, F.col(f"b{k}")) for k in range(1, 7)])
    two = clip(_f_ratio((F.col("tss") - best) / 3.0, best / 3.0), low=0.0)
    one = clip(_f_ratio(F.col("tss") - F.col("r07"), F.col("r07") / 5.0), low=0.0)
    rows = rows.withColumns({"f_two": two, "f_one": one})
    rows = rows.withColumn("pvalue", F.when(F.col("breakpoint").isNotNull(), _p_value(F.col("f_two"), f_cdf_3_3)).otherwise(_p_value(F.col("f_one"), f_cdf_1_5)))

    def at(i: int) -> Column:
        line = lambda a, b: F.col(f"c{a}{b}") + F.col(f"m{a}{b}") * F.lit(float(i))
        fit = F.coalesce(*[F.when(F.col("breakpoint") == k, line(0, k) if i < k else line(k, 7)) for k in range(1, 7)], line(0, 7))
        return F.when(true(F.col("pvalue") <= p_threshold), fit).otherwise(F.col("mean"))

    return rows.select(*keys, "breakpoint", "max_f", "pvalue", F.array(*[at(i) for i in range(7)]).alias("prediction"))
