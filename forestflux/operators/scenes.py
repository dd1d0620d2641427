"""Scenes on UTM grids: verified projections, target cells on the world's grid, and reprojection over the antimeridian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import FALSE_NORTHING, spans_band_edge, utm_band, utm_forward, utm_inverse

#: Metres by which a projected corner may differ from its metadata.
TOLERANCE = 2.0
#: Order in which corners are tried.
CORNERS = ("ur", "ll", "ul", "lr")
#: Points a side at which a scene's outline is projected, and steps of the target grid around it.
OUTLINE, BUFFER = 32, 1


def zone_letter(zone: Column) -> Column:
    """The latitude band of a scene with corner columns <corner>_lat, _lon, _x and _y.

    A scene within one band has that of its upper right corner. Over a band's edge it is the band of the first corner whose projection
    agrees with its metadata, northings in the south counted from the equator or from the pole alike; if none does, the row fails.
    """
    found = []
    for c in CORNERS:
        lat = F.col(f"{c}_lat")
        east, north = utm_forward(lat, F.col(f"{c}_lon"), zone)
        off = F.abs(north - F.col(f"{c}_y"))
        other = F.abs(north + FALSE_NORTHING - F.col(f"{c}_y"))
        agrees = (F.abs(east - F.col(f"{c}_x")) < TOLERANCE) & (F.when(lat < 0, F.least(off, other)).otherwise(off) < TOLERANCE)
        found.append(F.when(agrees, utm_band(lat)))
    fails = F.raise_error("no corner's projection agrees with the scene's metadata").cast("string")
    lats = F.array(*[F.col(f"{c}_lat") for c in CORNERS])
    return F.when(spans_band_edge(F.array_min(lats), F.array_max(lats)), F.coalesce(*found, fails)).otherwise(utm_band(F.col("ur_lat")))


def footprints(scenes: DataFrame) -> DataFrame:
    """scenes (scene_id, zone, south, east0, north0, step, nrow, ncol) with min_lat, max_lat, min_lon, max_lon and side.

    east0 and north0 are the centre of the first pixel, north0 without the southern false northing or with it if south. A scene over the
    antimeridian gives two rows, its east side up to 180 and its west side from -180; others are whole. Longitudes are compared as
    distances from the zone's meridian, so no scene is mistaken for one around the world.
    """
    part = F.transform(F.sequence(F.lit(0), F.lit(OUTLINE)), lambda i: i / float(OUTLINE))
    along = lambda r, c: F.transform(part, lambda t: F.struct(r(t).alias("r"), c(t).alias("c")))
    first, last = F.lit(-0.5), lambda n: F.col(n) - 0.5
    across = lambda n: lambda t: t * F.col(n) - 0.5
    sides = F.flatten(F.array(along(lambda t: first, across("ncol")), along(lambda t: last("nrow"), across("ncol")), along(across("nrow"), lambda t: first), along(across("nrow"), lambda t: last("ncol"))))
    points = scenes.withColumn("__p", F.explode(sides))
    north = F.col("north0") - F.col("__p.r") * F.col("step") - F.when(F.col("south"), F.lit(FALSE_NORTHING)).otherwise(0.0)
    lat, lon = utm_inverse(F.col("east0") + F.col("__p.c") * F.col("step"), north, F.col("zone"))
    points = points.select("scene_id", lat.alias("lat"), (lon - (F.col("zone") * 6 - 183)).alias("off"), "zone")
    box = points.groupBy("scene_id", "zone").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("off").alias("a"), F.max("off").alias("b"))
    low, high = F.col("zone") * 6 - 183 + F.col("a"), F.col("zone") * 6 - 183 + F.col("b")
    piece = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.cast("double").alias("min_lon"), y.cast("double").alias("max_lon"))
    pieces = F.when(low >= 180, F.array(piece("whole", low - 360, high - 360))).when(high <= -180, F.array(piece("whole", low + 360, high + 360)))
    pieces = pieces.when(high > 180, F.array(piece("east", low, F.lit(180.0)), piece("west", F.lit(-180.0), high - 360)))
    pieces = pieces.when(low < -180, F.array(piece("east", low + 360, F.lit(180.0)), piece("west", F.lit(-180.0), high))).otherwise(F.array(piece("whole", low, high)))
    found = box.select("scene_id", "min_lat", "max_lat", F.explode(pieces).alias("p")).select("scene_id", "min_lat", "max_lat", "p.*")
    return scenes.join(found, "scene_id")


def target_cells(scenes: DataFrame, step: float) -> DataFrame:
    """The cells of the world's grid (row 0 at 90 north, column 0 at 180 west) whose centres lie in a scene, with its pixel.

    (scene_id, side, iy, ix, lat, lon, row, col); rows of a scene are dealt out before their cells are made.
    """
    f = footprints(scenes)
    last = lambda v, most: F.least(v, F.lit(most)).cast("int")
    nlat, nlon = round(180 / step), round(360 / step)
    rows = F.sequence(F.greatest(F.floor((90 - F.col("max_lat")) / step) - BUFFER, F.lit(0)).cast("int"), last(F.floor((90 - F.col("min_lat")) / step) + BUFFER, nlat - 1))
    columns = F.sequence(F.greatest(F.floor((F.col("min_lon") + 180) / step) - BUFFER, F.lit(0)).cast("int"), last(F.floor((F.col("max_lon") + 180) / step) + BUFFER, nlon - 1))
    dealt = f.withColumn("iy", F.explode(rows)).repartition(F.col("scene_id"), F.col("iy"))
    cells = dealt.withColumn("ix", F.explode(columns)).withColumns({"lat": F.lit(90.0) - (F.col("iy") + 0.5) * step, "lon": (F.col("ix") + 0.5) * step - 180.0})
    # the buffer of a half ends at the antimeridian, so no cell is in both
    side = (F.col("side") == "whole") | ((F.col("side") == "east") == (F.col("lon") > 0))
    east, north = utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    north = north + F.when(F.col("south"), F.lit(FALSE_NORTHING)).otherwise(0.0)
    nearest = lambda v: F.floor(v / F.col("step") + 0.5).cast("int")
    cells = cells.where(side).withColumns({"col": nearest(east - F.col("east0")), "row": nearest(F.col("north0") - north)})
    inside = F.col("row").between(0, F.col("nrow") - 1) & F.col("col").between(0, F.col("ncol") - 1)
    return cells.where(inside).select("scene_id", "side", "iy", "ix", "lat", "lon", "row", "col")


def reproject(pixels: DataFrame, scenes: DataFrame, values: list[str], step: float, no_data: float = 1e100) -> DataFrame:
    """Pixels (scene_id, row, col, values) of scenes on the world's grid, by the nearest pixel; what is no_data or more is NULL.

    One equi-join: each target cell names its pixel. A cell whose pixel is not there has no row.
    """
    found = target_cells(scenes, step).join(pixels.select("scene_id", "row", "col", *values), ["scene_id", "row", "col"])
    return found.select("scene_id", "side", "iy", "ix", "lat", "lon", *[F.when(F.col(v) < no_data, F.col(v)).alias(v) for v in values])
