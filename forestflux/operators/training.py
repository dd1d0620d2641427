"""Training rows: shots with biomass, the pixels nearest to them, and the ancillary layers with their scales and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import utm_forward
from ..sources.catalog import exists
from .allometry import realm
from .filters import closed_box, complete_rows
from .joins import nearest_lookup

# Tiles without any biomass.
NO_BIOMASS_TILES = ["00N_070E", "20N_120W", "30N_170W", "40N_070W"]
# Climate variables that are kept in hundredths.
HUNDREDTHS = [*[f"BIO{i:02d}" for i in (1, 2, 5, 6, 7, 8, 9, 10, 11, 15)], "tavg", "tmax", "tmin", "vapr", "wind"]
# Land-cover codes that mean no data.
NLCD_NOTHING = (0, 241)
# What stands for no burn in the burn-date layers.
NO_BURN = (0, -1, -2)
SHOT_COLUMNS = ["biomass", "burned", "ecoregion", "lat", "lon"]


def biomass_of_year(shots: DataFrame, tiles: list[str], year: int) -> DataFrame:
    """Shots of these tiles with biomass, acquired in a year (UTC) of the epoch seconds in `time`; tile_id prunes partitions."""
    wanted = [t for t in tiles if t not in NO_BIOMASS_TILES]
    found = shots.where(F.col("tile_id").isin(wanted) & F.col("biomass").isNotNull())
    return found.withColumn("year", F.year(F.timestamp_seconds("time"))).where(F.col("year") == year)


def first_burn(dates: DataFrame, keys: list[str], date: str = "burn_date") -> DataFrame:
    """The first burn of each cell, as year * 1000 + day; fill values and cells that never burned give none."""
    return dates.groupBy(*keys).agg(F.min(F.when(~F.col(date).isin(*NO_BURN), F.col("year") * 1000 + F.col(date))).alias("first_burn"))


def with_climate(points: DataFrame, climate: DataFrame, variables: list[str], lat0: float, dlat: float, nlat: int, lon0: float, dlon: float, nlon: int, cast: str = "smallint") -> DataFrame:
    """Adds climate variables of the nearest cell, scaled and cast to whole numbers as the models take them."""
    scaled = climate.withColumns({v: F.col(v) * F.lit(100 if v in HUNDREDTHS else 1) for v in variables})
    packed = scaled.select("iy", "ix", F.struct(*variables).alias("__v"))
    out = nearest_lookup(points, packed, "__v", lat0, dlat, nlat, lon0, dlon, nlon)
    return out.withColumns({v: F.expr(f"try_cast(__v.{v} as {cast})") for v in variables}).drop("__v", "iy", "ix")


def with_terrain(points: DataFrame, terrain: DataFrame | None, *grid: float, cast: str = "smallint") -> DataFrame:
    """Adds elev, slope and aspect of the nearest cell, or NULL columns where there is no terrain at all."""
    names = ["elev", "slope", "aspect"]
    if terrain is None:
        return points.withColumns({v: F.lit(None).cast(cast) for v in names})
    out = nearest_lookup(points, terrain.select("iy", "ix", F.struct(*names).alias("__v")), "__v", *grid)
    return out.withColumns({v: F.expr(f"try_cast(__v.{v} as {cast})") for v in names}).drop("__v", "iy", "ix")


def land_cover(nlcd: Column) -> Column:
    """The national map's code, NULL for the codes that mean no data."""
    return F.when(~nlcd.isin(*NLCD_NOTHING), nlcd)


def with_land_cover(shots: DataFrame, layers: dict[str, DataFrame], *grid: float, years: tuple[int, int]) -> DataFrame:
    """Adds ecoregion, nlcd, eosd and igbp of the nearest cells; igbp by acquisition year. Layers that are not there give NULL."""
    out = shots
    for name in ("ecoregion", "nlcd", "eosd", "igbp"):
        if name in layers:
            out = nearest_lookup(out, layers[name], name, *grid, years=years if name == "igbp" else None).drop("iy", "ix")
        else:
            out = out.withColumn(name, F.lit(None).cast("int"))
    return out.withColumn("nlcd", land_cover(F.col("nlcd")))


def training_rows(shots: DataFrame, pixels: DataFrame, box: tuple[float, float, float, float], features: list[str], *grid: float) -> DataFrame:
    """Shots inside a closed box (min_lat, max_lat, min_lon, max_lon) with their realm and the features of the nearest pixel; complete rows only.

    A scene that yields nothing gives no rows, and the writer partitions by realm and year, so there is no file to stand for it.
    """
    inside = closed_box(shots.select(*SHOT_COLUMNS), *box).withColumn("realm", realm())
    found = nearest_lookup(inside, pixels.select("iy", "ix", F.struct(*features).alias("__v")), "__v", *grid)
    columns = [*SHOT_COLUMNS, "realm", *features]
    return complete_rows(found.select(*SHOT_COLUMNS, "realm", *[F.col(f"__v.{c}").alias(c) for c in features]), columns)


def write_training(rows: DataFrame, folder: str, year: int, scene: str) -> None:
    """Writes rows by realm, year and scene; writing a scene again replaces it alone."""
    parts = rows.withColumns({"year": F.lit(year), "scene": F.lit(scene)})
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("realm", "year", "scene").parquet(folder)


def training(spark, folder: str, realm_name: str, first: int = 2003, end: int = 2010) -> DataFrame:
    """All training rows of a realm from `first` up to but not including `end`; the folder's partitions do what a cached copy would."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    return spark.read.parquet(folder).where((F.col("realm") == realm_name) & (F.col("year") >= first) & (F.col("year") < end))


def parquet_url(folder: str, path: Column, row: Column, year: Column) -> Column:
    """Where a scene's rows are: <folder>/<path>/<row>/<year>/data.parquet."""
    return F.concat_ws("/", F.lit(folder.rstrip("/")), path.cast("string"), row.cast("string"), year.cast("string"), F.lit("data.parquet"))


def reproject_scene(targets: DataFrame, scene: DataFrame, value: str, east0: float, north0: float, step: float = 30.0, no_data: float = 1e100) -> DataFrame:
    """The target cells (lat, lon, zone and any other columns) with the value of a scene on a UTM grid (row, col, value), by the nearest source pixel.

    Each target computes its source pixel, so this is one equi-join; targets beyond the scene are left out, huge values are NULL.
    """
    east, north = utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    index = lambda v: F.floor(v / step + 0.5).cast("int")
    keyed = targets.withColumns({"col": index(east - east0), "row": index(F.lit(north0) - north)})
    out = keyed.join(scene.select("row", "col", value), ["row", "col"])
    return out.select(*targets.columns, F.when(F.abs(value) <= no_data, F.col(value)).alias(value))


# ---------------------------------------------------------------- small ones

#: Mass of carbon dioxide to that of carbon, and of biomass to that of its carbon.
CO2_PER_C, CARBON_SHARE = 3.664, 0.47


def megatonnes(tonnes: Column) -> Column:
    return tonnes / 1e6


def carbon_to_co2(carbon: Column) -> Column:
    return carbon * CO2_PER_C


def carbon_to_biomass(carbon: Column) -> Column:
    return carbon / CARBON_SHARE


def mean_of_totals(df: DataFrame, date: str, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The mean over dates of each date's total."""
    totals = df.groupBy(*keys, date).agg(F.sum(value).alias("total"))
    return totals.groupBy(*keys).agg(F.avg("total").alias("mean_total"))


def valid_records(df: DataFrame, waveform: str = "rec_wf", fill: float = 1e35) -> DataFrame:
    """Records none of whose bins is a fill value."""
    return df.where(F.forall(waveform, lambda x: x < fill))


def good_shots(df: DataFrame, flag: str = "quality_flag") -> DataFrame:
    return df.where(F.col(flag) == 1)


def tropical_zones(zones: DataFrame, name: str = "gez_name") -> DataFrame:
    """The ecological zones whose name begins with the word Tropical."""
    return zones.where(F.get(F.split(name, " "), F.lit(0)) == "Tropical")


def acquisition_time(seconds: Column) -> Column:
    """The time (UTC) of seconds after noon of 2000-01-01; that noon itself where there is none."""
    return F.timestamp_seconds(F.coalesce(seconds, F.lit(0)) + 946728000)
