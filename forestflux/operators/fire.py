"""Active-fire detections to burnt cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIRE_RADIUS_M, METRES_PER_DEGREE


def buffer_degrees(lat: Column, radius: float = FIRE_RADIUS_M) -> Column:
    """The radius in degrees at a latitude; one radius serves both axes."""
    return F.lit(radius) / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat)))


def burn_cells(points: DataFrame, west: float, north: float, step: float, nlat: int, nlon: int, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Distinct cells that any disc around a detection touches; points have lat, lon, radius (degrees) and the keys.

    The cells of each disc's box are generated, and those stay whose nearest point is within the radius.
    """
    x, y, r = (F.col("lon") - west) / step, (F.lit(north) - F.col("lat")) / step, F.col("radius") / step
    rows = points.select(*keys, x.alias("x"), y.alias("y"), r.alias("r"))
    near = lambda c, n: F.sequence(F.greatest(F.floor(F.col(c) - F.col("r")), F.lit(0)).cast("int"), F.least(F.floor(F.col(c) + F.col("r")), F.lit(n - 1)).cast("int"))
    inside = (F.col("x") + F.col("r") >= 0) & (F.col("x") - F.col("r") < nlon) & (F.col("y") + F.col("r") >= 0) & (F.col("y") - F.col("r") < nlat)
    cells = rows.where(inside).withColumn("ix", F.explode(near("x", nlon))).withColumn("iy", F.explode(near("y", nlat)))
    gap = lambda c, i: F.greatest(F.col(i) - F.col(c), F.lit(0.0), F.col(c) - F.col(i) - 1)
    d2 = gap("x", "ix") * gap("x", "ix") + gap("y", "iy") * gap("y", "iy")
    return cells.where(d2 <= F.col("r") * F.col("r")).select(*keys, "iy", "ix").distinct()


def burned_fraction(cells: DataFrame, factor: int, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Share of burnt cells in every coarse cell that has any."""
    from .aggregate import block

    return cells.groupBy(*keys, block("iy", factor), block("ix", factor)).agg((F.count(F.lit(1)) / F.lit(float(factor * factor))).alias("burned"))


def detections(points: DataFrame, radius: float = FIRE_RADIUS_M) -> DataFrame:
    """Detections of nominal or high confidence with their radius in degrees."""
    return points.where(F.col("confidence").isin("n", "h")).withColumn("radius", buffer_degrees(F.col("lat"), radius))
