"""A catalogue of named, parameterised sources, and readers that tolerate what is missing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import wrap_longitude
from ..functions.nulls import fill_to_null


@dataclass(frozen=True)
class Source:
    """A path template with defaults, its format and options, and an explicit schema where the format has none."""

    path: str
    format: str = "parquet"
    defaults: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    schema: str | None = None


CATALOG: dict[str, Source] = {
    "tree_cover": Source("{root}/treecover2000/{lat}_{lon}", defaults={"lat": "50N", "lon": "120W"}),
    "loss_year": Source("{root}/lossyear/{lat}_{lon}", defaults={"lat": "50N", "lon": "120W"}),
    "biomass_density": Source("{root}/agb/{lat}_{lon}", defaults={"lat": "50N", "lon": "120W"}),
    "emissions_tile": Source("{root}/{version}/emissions/{unit}/{lat}_{lon}", defaults={"version": "v1", "unit": "30m", "lat": "50N", "lon": "120W"}),
    "biomass_tile": Source("{root}/{version}/biomass/{lat}_{lon}", defaults={"version": "v1", "lat": "50N", "lon": "120W"}),
    "fire_mask": Source("{root}/fire/{unit}/year={year}", defaults={"unit": "30m", "year": 2014}),
    "country_rollup": Source("{root}/{version}/rollup", "csv", {"version": "v1"}, {"header": True}, "iso3_country string, begin_date date, end_date date, tCO2eq double"),
    "volt_table": Source("{root}/volt_table.csv", "csv", {}, {"header": True}, "ind int, volt_value double"),
    "scene_metadata": Source("{root}/scenes/{path}/{row}/*.json", "text", {"path": 45, "row": 30}, {"wholetext": True}),
}


def load(spark: SparkSession, name: str, catalog: dict[str, Source] = CATALOG, **params) -> DataFrame:
    """Reads a catalogue entry; parameters override its defaults."""
    if name not in catalog:
        raise KeyError(f"{name} is not in the catalogue, which has {', '.join(sorted(catalog))}")
    s = catalog[name]
    reader = spark.read.format(s.format).options(**s.options)
    if s.schema:
        reader = reader.schema(s.schema)
    return reader.load(s.path.format(**{**s.defaults, **params}))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_present(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """The union of those parquet paths that exist; empty with the schema if none does."""
    there = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def tiles_in_box(df: DataFrame, tiles: list[str] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A tiled raster restricted to tiles (a partition filter) and an inclusive box."""
    if tiles is not None:
        df = df.where(F.col("tile_id").isin(*tiles) if tiles else F.lit(False))
    if box:
        df = df.where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    return df


def change_tile(cover: DataFrame, loss: DataFrame, agb: DataFrame) -> DataFrame:
    """Tree cover as a share, loss year from 2000 (no loss) on, and biomass, joined by cell."""
    out = cover.join(loss, ["iy", "ix"]).join(agb, ["iy", "ix"])
    return out.withColumns({"treecover2000": F.col("treecover2000").cast("double") / 100, "lossyear": F.col("lossyear").cast("int") + 2000})


def shot_ids(record: F.Column, shot: F.Column) -> F.Column:
    """The composite id of a shot: record number to nine digits, shot number to two."""
    return F.concat_ws("_", F.lpad(record.cast("string"), 9, "0"), F.lpad(shot.cast("string"), 2, "0"))


def glah14(df: DataFrame) -> DataFrame:
    """Fill values over 1e30 to NULL in all doubles, longitude wrapped, id added."""
    numbers = {c: fill_to_null(F.col(c), above=1e30) for c, t in df.dtypes if t == "double"}
    out = df.withColumns(numbers)
    return out.withColumns({"lon": wrap_longitude(F.col("lon")), "shot_id": shot_ids(F.col("record_index"), F.col("shot_number"))})


def sample_locations(table: F.Column, index: F.Column) -> F.Column:
    """The row of a table of sample locations that a 1-based index names; 127 means none."""
    return F.when(index != 127, F.get(table, (index - 1).cast("int")))


def first_by_basename(links: DataFrame) -> DataFrame:
    """Download links out of search results: usable ones, the first of each file name (by position)."""
    from pyspark.sql import Window

    usable = F.col("href").isNotNull() & ~F.coalesce(F.col("inherited"), F.lit(False)) & F.col("rel").contains("data#") & ~F.lower(F.coalesce("title", F.lit(""))).contains("opendap")
    rows = links.where(usable).withColumn("basename", F.element_at(F.split("href", "/"), -1))
    order = Window.partitionBy("basename").orderBy("position")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("position", "href", "basename")


def batches(df: DataFrame, key: str, size: int, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """Numbers rows in batches of `size` by key order, then by the columns in ties; no task sees all rows."""
    from ..operators.ranks import global_rank

    ranked = global_rank(df, key, ties)
    return ranked.withColumn("batch", F.floor(F.col("rank") / size).cast("int")).drop("rank")
