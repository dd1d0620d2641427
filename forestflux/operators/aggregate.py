"""Coarsening, rollups, gridding of points, histograms and error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_div
from ..functions.stats import bias, mae, r2, rmse


def block(c: str, factor: int) -> Column:
    return F.floor(F.col(c) / factor).cast("int").alias(c)


def coarsen_sum(df: DataFrame, value: str, area: str, factor: int, mask: str | None = None, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Sum of value * area per block; area is NULL where the mask is, and a block without a value is 0."""
    weight = F.when(F.col(mask).isNotNull(), F.col(area)) if mask else F.col(area)
    return df.groupBy(block("iy", factor), block("ix", factor), *keys).agg(F.coalesce(F.sum(F.col(value) * weight), F.lit(0.0)).alias(value))


def coarsen_mean(df: DataFrame, value: str, area: str, factor: int, mask: str, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Sum of value * area over sum of area, the area masked like in coarsen_sum; NULL without area."""
    weight = F.when(F.col(mask).isNotNull(), F.col(area))
    return df.groupBy(block("iy", factor), block("ix", factor), *keys).agg(safe_div(F.coalesce(F.sum(F.col(value) * weight), F.lit(0.0)), F.sum(weight)).alias(value))


def coarsen_plain(df: DataFrame, values: list[str], factor: int, how: str = "mean", shape: tuple[int, int] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted mean or sum per block; with a shape the rows and columns of incomplete blocks are trimmed."""
    if how not in ("mean", "sum"):
        raise NotImplementedError(how)
    if shape:
        df = df.where((F.col("iy") < shape[0] - shape[0] % factor) & (F.col("ix") < shape[1] - shape[1] % factor))
    f = F.avg if how == "mean" else F.sum
    return df.groupBy(block("iy", factor), block("ix", factor), *keys).agg(*[f(v).alias(v) for v in values])


def regional_totals(df: DataFrame, names: DataFrame, values: list[str]) -> DataFrame:
    """Sums per region and year with the year's first day and the next year's; cells outside all regions don't count.

    df has region, year and values; names has region and code.
    """
    total = df.where(F.col("region").isNotNull()).groupBy("region", "year").agg(*[F.sum(v).alias(v) for v in values])
    out = total.join(names, "region")
    return out.select("code", F.make_date("year", F.lit(1), F.lit(1)).alias("begin_date"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).alias("end_date"), *values)


def regional_totals_of_years(df: DataFrame, names: DataFrame, values: list[str], first: int, last: int) -> DataFrame:
    """Like regional_totals for rows of which each has a value in one year at most (NULL for none): all years of each region, 0 without rows."""
    total = df.where(F.col("region").isNotNull()).groupBy("region", "year").agg(*[F.sum(v).alias(v) for v in values])
    known = F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", F.struct(*values).alias("v"))))
    each = total.groupBy("region").agg(F.map_from_entries(known).alias("m")).withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    each = each.withColumn("v", F.element_at("m", F.col("year")))
    return regional_totals(each.select("region", "year", *[F.coalesce(F.col(f"v.{v}"), F.lit(0.0)).alias(v) for v in values]), names, values)


def weighted_mean(df: DataFrame, keys: list[str], value: str, area: str, name: str | None = None) -> DataFrame:
    """Sum of value * area over the sum of all area, also where the value is NULL."""
    return df.groupBy(*keys).agg(safe_div(F.sum(F.col(value) * F.col(area)), F.sum(area)).alias(name or value))


def grid_points(df: DataFrame, x: str, y: str, value: str, west: float, north: float, step: float, nlat: int, nlon: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the points in each cell; points off the grid are dropped."""
    from ..functions.grid import column_key, row_key

    cells = df.withColumns({"ix": column_key(F.round(x, 6), west, step), "iy": row_key(F.round(y, 6), north, step)})
    cells = cells.where(F.col("ix").between(0, nlon - 1) & F.col("iy").between(0, nlat - 1))
    return cells.groupBy("iy", "ix", *keys).agg(F.avg(value).alias(value))


def cut_right_closed(v: Column, low: float, step: float) -> Column:
    """Number of the bin (a, b] that holds the value."""
    return (F.ceil(F.round((v - low) / step, 6)) - 1).cast("int")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts in equal bins; the last bin holds its upper edge, values outside don't count."""
    raw = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    number = F.least(raw, F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    step = (high - low) / bins
    number = lambda c: F.least(F.floor((F.col(c) - low) / step).cast("int"), F.lit(bins - 1))
    inside = F.col(x).between(low, high) & F.col(y).between(low, high)
    return df.where(inside).groupBy(number(x).alias("bin_x"), number(y).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def error_metrics(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    return df.groupBy(*keys).agg(bias(y, p).alias("bias"), mae(y, p).alias("mae"), rmse(y, p).alias("rmse"), r2(y, p).alias("r2"), F.count(F.lit(1)).alias("n"))


def threshold_sweep(df: DataFrame, count: str, thresholds: list[int], truth: str, predicted: str, levels: list[str]) -> DataFrame:
    """Error metrics of the rows with at least each threshold of shots: over all, then by ever more of the levels."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col(count) >= F.col("threshold"))
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    sets = [[F.col("threshold"), *[F.col(c) for c in levels[:k]]] for k in range(len(levels) + 1)]
    return rows.groupingSets(sets, "threshold", *levels).agg(bias(y, p).alias("bias"), mae(y, p).alias("mae"), F.count(F.lit(1)).alias("n"))


def composite(df: DataFrame, bands: list[str], counter: str, keys: tuple[str, ...] = ("iy", "ix")) -> DataFrame:
    """Mean scene value per pixel: every band's sum is divided by the number of scenes with the first band, NULL without any."""
    n = F.nullif(F.count(counter), F.lit(0))
    return df.groupBy(*keys).agg(*[(F.sum(F.coalesce(F.col(b), F.lit(0.0))) / n).alias(b) for b in bands])


def month_weighted_mean(df: DataFrame, keys: list[str], value: str, month: str = "month") -> DataFrame:
    """Mean over months by their length, February counted as 28.25 days, of the months that have a value."""
    from ..constants import MONTH_DAYS

    days = F.element_at(F.array(*[F.lit(float(d)) for d in MONTH_DAYS]), F.col(month).cast("int"))
    weight = F.when(F.col(value).isNotNull(), days)
    return df.groupBy(*keys).agg(safe_div(F.sum(F.col(value) * weight), F.sum(weight)).alias(value))


def pyramid(df: DataFrame, value: str, levels: int) -> DataFrame:
    """Means on levels 0 (as given) to levels - 1, each with cells twice as wide, in one pass over the rows."""
    rows = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = F.pow(F.lit(2.0), F.col("level"))
    return rows.groupBy("level", F.floor(F.col("iy") / size).cast("int").alias("iy"), F.floor(F.col("ix") / size).cast("int").alias("ix")).agg(F.avg(value).alias(value))
