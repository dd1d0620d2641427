"""Scene selection, reflectance, indices and composites of Landsat scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div
from .aggregate import composite

BANDS = ("SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B7")


def months_of_interest(row: Column) -> Column:
    """Summer months of a scene row: northern up to row 40, southern from 80, all months between."""
    months = lambda *m: F.array(*map(F.lit, m))
    return F.when(row <= 40, months(6, 7, 8)).when(row >= 80, months(12, 1, 2)).otherwise(months(*range(1, 13)))


def date_stamps(months: Column, year: Column) -> Column:
    """YYYYMM of each month; January and February belong to the next year, everywhere."""
    return F.transform(months, lambda m: F.when(m < 3, year + 1).otherwise(year) * 100 + m)


def season_year(month: Column, year: Column) -> Column:
    """The year whose season a month belongs to: January and February count to the year before."""
    return F.when(month < 3, year - 1).otherwise(year)


def usable_scene(name: Column, stamps: Column) -> Column:
    """A tier-1 scene whose acquisition month is among the stamps; the date is the fourth token from the end."""
    token = F.element_at(F.split(name, "_"), -4)
    return name.contains("_T1") & F.array_contains(stamps, F.left(token, F.lit(6)).cast("int"))


def reflectance(df: DataFrame, bands: tuple[str, ...] = BANDS, qa: str = "cloud_qa") -> DataFrame:
    """Bands as reflectance, NULL where missing (0) or cloudy."""
    clear = F.coalesce(F.col(qa) < 2, F.lit(False))
    return df.withColumns({b: F.when(clear & (F.col(b) != 0), F.col(b) * F.lit(0.0000275) - F.lit(0.2)) for b in bands})


def ndvi(df: str = "") -> Column:
    return safe_div(F.col("SR_B4") - F.col("SR_B3"), F.col("SR_B4") + F.col("SR_B3"))


def ndii() -> Column:
    return safe_div(F.col("SR_B4") - F.col("SR_B5"), F.col("SR_B4") + F.col("SR_B5"))


def nir_v() -> Column:
    return F.col("SR_B4") * F.col("NDVI")


def with_indices(df: DataFrame) -> DataFrame:
    return df.withColumns({"NDVI": ndvi(), "NDII": ndii()}).withColumn("NIR_V", nir_v())


def common_projection(scenes: DataFrame, keys: tuple[str, ...], letter: str = "utm_letter") -> DataFrame:
    """Scenes of each key's most frequent UTM letter; of equally frequent ones the last in the alphabet."""
    counts = scenes.groupBy(*keys, letter).agg(F.countDistinct("scene_id").alias("__n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("__n", letter))[letter].alias(letter))
    return scenes.join(best, [*keys, letter], "left_semi")


def seasonal_average(pixels: DataFrame, keys: tuple[str, ...] = ("iy", "ix")) -> DataFrame:
    """Composite of a season's scene pixels: reflectance, indices, then the mean over the scenes with a first band."""
    rows = with_indices(reflectance(pixels))
    return composite(rows, [*BANDS, "NDVI", "NDII"], "SR_B1", keys)


def scene_metadata(json: Column) -> dict[str, Column]:
    """UTM zone and corner coordinates of a scene's metadata document."""
    root = "$.LANDSAT_METADATA_FILE.PROJECTION_ATTRIBUTES."
    get = lambda k: F.get_json_object(json, root + k)
    corners = {f"{c.lower()}_{a}": get(f"CORNER_{c}_{a.upper()}_PRODUCT").cast("double") for c in ("UL", "UR", "LL", "LR") for a in ("lat", "lon")}
    return {"utm_zone": get("UTM_ZONE").cast("int"), **corners}


def split_antimeridian(df: DataFrame, lon: str = "lon", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Adds side: east and west halves of scenes that reach over 180 degrees, else whole."""
    w = Window.partitionBy(*keys)
    over = (F.max(lon).over(w) >= 170) & (F.min(lon).over(w) <= -170)
    return df.withColumn("side", F.when(~over, "whole").when(F.col(lon) >= 0, "east").otherwise("west"))
