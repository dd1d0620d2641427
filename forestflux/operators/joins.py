"""Joins on integer grid keys, polygons and rounded coordinates. No plan here contains a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import boxes_overlap
from ..functions.grid import nearest_key, nearest_year
from .polygons import points_in


def nearest_lookup(points: DataFrame, grid: DataFrame, value: str, lat0: float, dlat: float, nlat: int, lon0: float, dlon: float, nlon: int, years: tuple[int, int] | None = None, lat: str = "lat", lon: str = "lon", cast: str | None = None) -> DataFrame:
    """The value of the nearest cell, however far: coordinates beyond the grid clamp to its edge, years to its first or last.

    grid has iy, ix[, year] and the value. The lookup is an equi-join on computed keys; Spark broadcasts the grid if it is small.
    """
    keys = {"iy": nearest_key(F.col(lat), lat0, dlat, nlat), "ix": nearest_key(F.col(lon), lon0, dlon, nlon)}
    on = ["iy", "ix"]
    if years:
        keys["__y"] = nearest_year(F.col("year"), *years)
        grid, on = grid.withColumnRenamed("year", "__y"), [*on, "__y"]
    out = points.drop("iy", "ix").withColumns(keys).join(grid.select(*on, value), on, "left")
    if cast:
        out = out.withColumn(value, F.expr(f"try_cast({value} as {cast})"))
    return out.drop("__y")


def within(value: Column, lat: Column, lon: Column, cell_lat: Column, cell_lon: Column, tolerance: float) -> Column:
    """A looked-up value only if the cell is near enough on both axes."""
    return F.when((F.abs(lat - cell_lat) <= tolerance) & (F.abs(lon - cell_lon) <= tolerance), value)


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, how: str = "inner") -> DataFrame:
    """Every pair of a point and a polygon (id, ring or rings, and other columns) that holds it; how="first" keeps the least id.

    Points meet cells of a quad-tree cover, never rings; the polygons' other columns are joined by id.
    """
    whole = polygons if "rings" in polygons.columns else polygons.withColumn("rings", F.array("ring"))
    found = points_in(points, whole, x, y)
    if how == "first":
        found = found.groupBy(*points.columns).agg(F.min("id").alias("id"))
    names = polygons.drop("ring", "rings")
    return found.join(names.dropDuplicates(["id"]), "id").select(*points.columns, *names.columns) if len(names.columns) > 1 else found


def polygon_mask(cells: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """cells with the id of the polygon that holds their centre, NULL outside all; of several the least id."""
    found = points_in_polygons(cells.select("iy", "ix", x, y).distinct(), polygons.select("id", "ring"), x, y, how="first").select("iy", "ix", F.col("id").alias("region"))
    return cells.join(found, ["iy", "ix"], "left")


def tiles_over_boxes(tiles: DataFrame, boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """Pairs of tiles and boxes that overlap; both have min_x, max_x, min_y, max_y."""
    keys = lambda p: F.sequence(F.floor(F.col(f"{p}min_x") / size).cast("int"), F.floor(F.col(f"{p}max_x") / size).cast("int"))
    t = tiles.withColumn("__k", F.explode(keys("")))
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns]).withColumn("__k", F.explode(keys("b_")))
    hit = boxes_overlap(F.col("min_x"), F.col("max_x"), F.col("b_min_x"), F.col("b_max_x")) & boxes_overlap(F.col("min_y"), F.col("max_y"), F.col("b_min_y"), F.col("b_max_y"))
    return t.join(b, "__k").where(hit).drop("__k").distinct()


def strict_lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Dictionary lookup that fails on a key that the table lacks."""
    out = df.join(table.select(key, value, F.lit(True).alias("__hit")), key, "left")
    fail = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string"))).cast(dict(table.dtypes)[value])
    return out.withColumn(value, F.when(F.col("__hit") | F.col(key).isNull(), F.col(value)).otherwise(fail)).drop("__hit")


def rounded_join(a: DataFrame, b: DataFrame, decimals: int, on: tuple[str, ...] = (), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Inner join on coordinates rounded half to even, and other keys; b's other columns get the suffix _b."""
    key = lambda df: df.withColumns({"__lat": F.bround(lat, decimals), "__lon": F.bround(lon, decimals)})
    right = key(b)
    right = right.select("__lat", "__lon", *on, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in on])
    return key(a).join(right, ["__lat", "__lon", *on]).drop("__lat", "__lon")


def full_grid(spark, nlat: int, nlon: int) -> DataFrame:
    rows = spark.range(nlat * nlon)
    return rows.select(F.expr(f"cast(id div {nlon} as int)").alias("iy"), F.expr(f"cast(id % {nlon} as int)").alias("ix"))


def reindex(df: DataFrame, nlat: int, nlon: int) -> DataFrame:
    """One row per cell of the grid, NULLs where df has none; rows off the grid are dropped."""
    return full_grid(df.sparkSession, nlat, nlon).join(df, ["iy", "ix"], "left")


def forward_fill_years(df: DataFrame, keys: list[str], value: str, first: int, last: int) -> DataFrame:
    """A row for every key and year; years without a value get the last known one before."""
    years = df.select(*keys).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    both = years.join(df.withColumn("__own", F.lit(True)), [*keys, "year"], "full")
    order = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(order)).where(F.col("year").between(first, last)).drop("__own")
