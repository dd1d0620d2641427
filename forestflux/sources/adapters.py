"""Inputs of the engine's operators derived from the driver's relational tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.polygons import Grid


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_year(spark: SparkSession, sf_dir: str, m: int = 20) -> DataFrame:
    """(ix, iy, year, agb): mean quantity per part and supplier class and shipping year."""
    li = read(spark, sf_dir, "lineitem")
    cell = li.groupBy((F.col("l_partkey") % m).cast("int").alias("ix"), (F.col("l_suppkey") % m).cast("int").alias("iy"), F.year("l_shipdate").alias("year"))
    return cell.agg(F.avg("l_quantity").alias("agb"))


def sql_pixel_year(m: int = 20) -> str:
    return f"select cast(l_partkey % {m} as int) ix, cast(l_suppkey % {m} as int) iy, cast(year(l_shipdate) as int) as year, avg(l_quantity) agb from lineitem group by all"


#: The quarter-degree grid of 40 x 40 cells that pixel_year(40) and the like fill; the cells of smaller ones are its first.
GRID = Grid(west=0.0, north=10.0, step=0.25, nlat=40, nlon=40)


def with_position(df: DataFrame) -> DataFrame:
    """Adds lat and lon of the cell's centre on a quarter-degree grid."""
    return df.withColumns({"lat": F.lit(10.0) - (F.col("iy") + 0.5) / 4, "lon": (F.col("ix") + 0.5) / 4})


SQL_POSITION = "10.0::double - (iy + 0.5::double) / 4 as lat, (ix + 0.5::double) / 4 as lon"


def static_raster(spark: SparkSession, sf_dir: str, m: int = 20) -> DataFrame:
    """(ix, iy, agb, lossyear) with 2000 for no loss."""
    li = read(spark, sf_dir, "lineitem")
    cell = li.groupBy((F.col("l_partkey") % m).cast("int").alias("ix"), (F.col("l_suppkey") % m).cast("int").alias("iy"))
    return cell.agg(F.avg("l_quantity").alias("agb")).withColumn("lossyear", 2000 + (F.col("ix") * 7 + F.col("iy") * 13) % 8)


def sql_static(m: int = 20) -> str:
    return f"select *, 2000 + (ix * 7 + iy * 13) % 8 as lossyear from (select cast(l_partkey % {m} as int) ix, cast(l_suppkey % {m} as int) iy, avg(l_quantity) agb from lineitem group by all)"


def burned(spark: SparkSession, sf_dir: str, m: int = 20) -> DataFrame:
    """Distinct (ix, iy, year) with a returned line."""
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 1")
    return li.select((F.col("l_partkey") % m).cast("int").alias("ix"), (F.col("l_suppkey") % m).cast("int").alias("iy"), F.year("l_shipdate").alias("year")).distinct()


def sql_burned(m: int = 20) -> str:
    return f"select distinct cast(l_partkey % {m} as int) ix, cast(l_suppkey % {m} as int) iy, cast(year(l_shipdate) as int) as year from lineitem where l_returnflag = 'R' and l_linenumber = 1"


def landcover(spark: SparkSession, sf_dir: str, m: int = 20) -> DataFrame:
    """(ix, iy, year, igbp): the least class among a cell's lines; 17 classes, 0 to 16."""
    li = read(spark, sf_dir, "lineitem")
    cell = li.groupBy((F.col("l_partkey") % m).cast("int").alias("ix"), (F.col("l_suppkey") % m).cast("int").alias("iy"), F.year("l_shipdate").alias("year"))
    return cell.agg((F.max("l_orderkey") % 17).cast("int").alias("igbp"))


def sql_landcover(m: int = 20) -> str:
    return f"select cast(l_partkey % {m} as int) ix, cast(l_suppkey % {m} as int) iy, cast(year(l_shipdate) as int) as year, cast(max(l_orderkey) % 17 as int) igbp from lineitem group by all"


def regions(spark: SparkSession, sf_dir: str, m: int = 20) -> DataFrame:
    """25 rectangles of cells (id, code, realm, ring) in degrees; the last is half as wide, so some cells lie outside all."""
    from ..functions.geometry import box_ring

    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    w = m // 5
    x0, y1 = (F.col("n_nationkey") % 5) * w / 4.0, F.lit(10.0) - F.floor(F.col("n_nationkey") / 5) * w / 4.0
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"), F.col("r_name").alias("realm"), box_ring(x0, y1 - w / 4.0, x0 + F.when(F.col("n_nationkey") == 24, w / 8.0).otherwise(w / 4.0), y1).alias("ring"))


def sql_regions(m: int = 20) -> str:
    w = m // 5
    return f"select n_nationkey id, n_name code, r_name realm, (n_nationkey % 5) * {w} x0, (n_nationkey // 5) * {w} y0, (n_nationkey % 5) * {w} + case when n_nationkey = 24 then {w // 2} else {w} end x1, (n_nationkey // 5) * {w} + {w} y1 from nation join region on n_regionkey = r_regionkey"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, biomass, year) of orders."""
    o = read(spark, sf_dir, "orders")
    return o.select(((F.col("o_custkey") % 400) / 40.0).alias("x"), (F.lit(10.0) - (F.col("o_orderkey") % 401) / 40.0).alias("y"), (F.floor("o_totalprice") / 1000).alias("biomass"), F.year("o_orderdate").alias("year"))


SQL_POINTS = "select (o_custkey % 400) / 40.0::double as x, 10.0::double - (o_orderkey % 401) / 40.0::double as y, floor(o_totalprice) / 1000 as biomass, cast(year(o_orderdate) as int) as year from orders"


def fire_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lat, lon, confidence, year) of events."""
    e = read(spark, sf_dir, "events")
    conf = F.when(F.col("event_type") == "error", "h").when(F.col("event_type") == "click", "n").otherwise("l")
    return e.select((F.col("user_id") % 20).cast("double").alias("lat"), ((F.col("event_id") % 40) + 0.3).alias("lon"), conf.alias("confidence"), (2012 + F.col("event_id") % 3).cast("int").alias("year"))


SQL_FIRE_POINTS = "select cast(user_id % 20 as double) lat, (event_id % 40) + 0.3::double lon, case event_type when 'error' then 'h' when 'click' then 'n' else 'l' end confidence, cast(2012 + event_id % 3 as int) as year from events"


def pools_input(spark: SparkSession, sf_dir: str, m: int = 20) -> DataFrame:
    """pixel_year with tropics, elevation and rain by cell."""
    df = pixel_year(spark, sf_dir, m)
    return df.withColumns({"is_tropics": F.when(F.col("ix") % 7 == 0, None).otherwise(F.col("iy") % 3 < 2), "elevation": (100.0 * ((F.col("ix") * 3 + F.col("iy")) % 30)), "precipitation": (100.0 * ((F.col("ix") + F.col("iy") * 5) % 23))})


def sql_pools_input(m: int = 20) -> str:
    return f"select *, case when ix % 7 = 0 then null else iy % 3 < 2 end is_tropics, 100.0::double * ((ix * 3 + iy) % 30) elevation, 100.0::double * ((ix + iy * 5) % 23) precipitation from ({sql_pixel_year(m)})"


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lidar shots from embeddings: 64 bins, 0.125 m apart."""
    e = read(spark, sf_dir, "embeddings")
    wf = F.transform("embedding", lambda v: v.cast("double") + 0.6)
    rows = e.select("vec_id", "label", wf.alias("rec_wf"))
    k = F.sequence(F.lit(0), F.lit(5))
    return rows.withColumns(
        {
            "dist": F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(600000.0) - F.lit(0.125) * i),
            "sig_begin_offset": F.lit(-7.5625), "sig_end_offset": F.lit(-1.0625), "noise_mean": F.lit(0.05), "noise_sd": F.lit(0.01),
            "gaussian_mu": F.transform(k, lambda i: F.lit(-1.25) * i), "gaussian_amp": F.slice("rec_wf", 1, 6), "gaussian_sigma": F.transform(k, lambda i: 4.0 + (F.col("vec_id") % 5)),
            "num_gaussian_peaks": (F.col("vec_id") % 6 + 1).cast("int"), "centroid_offset": F.lit(-4.0), "time": (F.col("vec_id") * 100000 + 1128000000).cast("double"),
            "lat": F.when(F.col("vec_id") % 97 == 0, None).otherwise(F.col("vec_id") % 120 - 60).cast("double"),
        }
    )


#: Shots with one row per bin (0-based i), for oracles.
SQL_BINS = "select vec_id, label, i, cast(embedding[i + 1] as double) + 0.6::double w, 600000.0::double - 0.125::double * i d from embeddings, range(64) t(i)"
