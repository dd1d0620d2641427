"""Conservative resampling between rasters that need not nest, and the cutting of rasters into tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import tile_tag
from ..functions.nulls import safe_div
from .polygons import Grid

#: Part of a cell under which an overlap comes from rounding.
SLIVER = 1e-9


def _overlaps(low: Column, high: Column, first: float, step: float, n: int) -> Column:
    """Array of (to, low, high) of the intervals of a regular axis that overlap low..high, in units of the axis' own steps."""
    a, b = (low - first) / step, (high - first) / step
    start, stop = F.greatest(F.floor(a + SLIVER), F.lit(0)).cast("int"), F.least(F.ceil(b - SLIVER) - 1, F.lit(n - 1)).cast("int")
    cut = F.transform(F.sequence(start, stop), lambda i: F.struct(i.alias("to"), F.greatest(a, i.cast("double")).alias("low"), F.least(b, i + 1.0).alias("high")))
    return F.when(start <= stop, cut)


def _height(grid: Grid, low: Column, high: Column, sphere: bool) -> Column:
    """Size of a span of rows: degrees, or what is in proportion to area on a sphere."""
    if not sphere:
        return (high - low) * grid.step
    lat = lambda row: F.radians(F.lit(grid.north) - row * grid.step)
    return F.sin(lat(low)) - F.sin(lat(high))


def regrid(df: DataFrame, source: Grid, target: Grid, values: list[str], how: str = "sum", keys: tuple[str, ...] = (), sphere: bool = False) -> DataFrame:
    """Cells (iy, ix, keys, values) of one raster on another, by the area that two cells share.

    "sum" deals each cell's amount to the cells it overlaps, in proportion; what overlaps the target as a whole keeps its total. "mean"
    is the mean by shared area of the cells with a value. Both axes are cut apart by numbers computed per row, so there is no join; a
    cell meets the few it overlaps, and sums begin in the task that reads them. Cells beyond the target are left out; NULL adds nothing.
    """
    if how not in ("sum", "mean"):
        raise NotImplementedError(how)
    north, south = F.lit(source.north) - F.col("iy") * source.step, F.lit(source.north) - (F.col("iy") + 1) * source.step
    west, east = F.lit(source.west) + F.col("ix") * source.step, F.lit(source.west) + (F.col("ix") + 1) * source.step
    rows = _overlaps(-north, -south, -target.north, target.step, target.nlat)
    columns = _overlaps(west, east, target.west, target.step, target.nlon)
    cut = df.select(*keys, *values, "iy", F.explode(rows).alias("r"), columns.alias("cs")).select(*keys, *values, "iy", "r", F.explode("cs").alias("c"))
    height = _height(target, F.col("r.low"), F.col("r.high"), sphere)
    width = (F.col("c.high") - F.col("c.low")) * target.step
    whole = _height(source, F.col("iy"), F.col("iy") + 1, sphere) * source.step
    weight = height * width / whole if how == "sum" else height * width
    flat = cut.select(F.col("r.to").alias("iy"), F.col("c.to").alias("ix"), *keys, *values, weight.alias("__w"))
    if how == "sum":
        return flat.groupBy("iy", "ix", *keys).agg(*[F.sum(F.col(v) * F.col("__w")).alias(v) for v in values])
    mean = lambda v: safe_div(F.sum(F.col(v) * F.col("__w")), F.sum(F.when(F.col(v).isNotNull(), F.col("__w"))))
    return flat.groupBy("iy", "ix", *keys).agg(*[mean(v).alias(v) for v in values])


def into_tiles(df: DataFrame, grid: Grid, size: int = 10) -> DataFrame:
    """Adds tile_id (tags of its north-west corner) and numbers iy and ix as counted within the tile; tiles hold whole cells."""
    per = round(size / grid.step)
    if abs(per * grid.step - size) > SLIVER:
        raise ValueError("the tile is no whole number of cells wide")
    # numbers on the grid of the whole world, whose first row begins at 90 degrees north and first column at 180 west
    y, x = F.col("iy") + round((90 - grid.north) / grid.step), F.col("ix") + round((grid.west + 180) / grid.step)
    top = round((90 % size) / grid.step)  # rows above the first tile edge, if 90 is none
    row, column = F.floor((y - top) / per), F.floor(x / per)
    lat_tag, lon_tag = tile_tag(F.lit(90 - 90 % size) - row * size, F.lit(-180) + column * size)
    return df.withColumns({"tile_id": F.concat_ws("_", lat_tag, lon_tag), "iy": (y - top - row * per).cast("int"), "ix": (x - column * per).cast("int")})
