"""Training-set assembly, ancillary layers and small conversions, over inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import training
from ..operators.allometry import ECOREGION_GROUPS
from ..operators.filters import complete_rows
from ..operators.joins import nearest_lookup
from ..sources import adapters as A
from .lidar import _REALM_OF, _grouped
from .registry import query

_GRID = (9.875, -0.25, 20, 0.125, 0.25, 20)
_IY, _IX = "cast(least(greatest(floor((lat - 9.875) / -0.25 + 0.5), 0), 19) as int)", "cast(least(greatest(floor((lon - 0.125) / 0.25 + 0.5), 0), 19) as int)"

_SHOTS = """select o_orderkey shot, case o_custkey % 6 when 0 then '00N_070E' when 1 then '20N_120W' else (o_custkey % 6 * 10) || 'N_100W' end tile_id, case when o_orderkey % 9 > 0 then floor(o_totalprice) / 1000 end biomass,
 epoch(o_orderdate::timestamp)::bigint + 3600 as time, o_orderkey % 11 = 0 burned, cast(o_custkey % 847 as int) ecoregion, 10.0::double - (o_orderkey % 401) / 40.0::double lat, (o_custkey % 400) / 40.0::double lon from orders"""


def _shots(spark, d):
    o = A.read(spark, d, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    tile = F.when(c % 6 == 0, "00N_070E").when(c % 6 == 1, "20N_120W").otherwise(F.concat((c % 6 * 10).cast("string"), F.lit("N_100W")))
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 3600
    return o.select(
        k.alias("shot"), tile.alias("tile_id"), F.when(k % 9 > 0, F.floor("o_totalprice") / 1000).alias("biomass"), seconds.alias("time"), (k % 11 == 0).alias("burned"),
        (c % 847).cast("int").alias("ecoregion"), (F.lit(10.0) - (k % 401) / 40.0).alias("lat"), ((c % 400) / 40.0).alias("lon"),
    )


@query("a15_biomass_of_year", f"select shot, tile_id, biomass, cast(1996 as int) as year from ({_SHOTS}) where tile_id in ('20N_100W', '30N_100W') and biomass is not null and year(make_timestamp(time * 1000000)) = 1996")
def a15(spark, d):
    return training.biomass_of_year(_shots(spark, d), ["00N_070E", "20N_100W", "30N_100W"], 1996).select("shot", "tile_id", "biomass", "year")


_PIXELS = "select iy, ix, (iy * 31 + ix * 17) % 101 / 4.0::double SR_B1, case when (iy + ix) % 7 > 0 then (iy * 13 + ix * 5) % 89 / 8.0::double end NDVI from (select distinct cast(l_partkey % 20 as int) ix, cast(l_suppkey % 20 as int) iy from lineitem)"


def _pixels(spark, d):
    i, j = F.col("iy"), F.col("ix")
    cells = A.read(spark, d, "lineitem").select((F.col("l_partkey") % 20).cast("int").alias("ix"), (F.col("l_suppkey") % 20).cast("int").alias("iy")).distinct()
    return cells.select("iy", "ix", ((i * 31 + j * 17) % 101 / 4.0).alias("SR_B1"), F.when((i + j) % 7 > 0, (i * 13 + j * 5) % 89 / 8.0).alias("NDVI"))


_INSIDE = f"select *, {_IY} iy, {_IX} ix from ({_SHOTS}) where lat between 2 and 8 and lon between 1 and 9 and biomass is not null"


@query(
    "l12_training_rows",
    f"""select biomass, burned, ecoregion, lat, lon, realm, SR_B1, NDVI from (select *, case when ecoregion in (0, 129, 133) then 'ice' when ecoregion = 622 then 'tropical_asia' else {_REALM_OF} end realm
 from ({_grouped('ecoregion', _INSIDE, ECOREGION_GROUPS, 'eco')})) join ({_PIXELS}) using (iy, ix) where NDVI is not null""",
)
def l12(spark, d):
    return training.training_rows(_shots(spark, d), _pixels(spark, d), (2, 8, 1, 9), ["SR_B1", "NDVI"], *_GRID)


@query("b9_complete_shots", f"select shot, biomass, NDVI from (select *, {_IY} iy, {_IX} ix from ({_SHOTS})) left join ({_PIXELS}) using (iy, ix) where biomass is not null and NDVI is not null")
def b9_shots(spark, d):
    """Shots with biomass and an index at their pixel; of the others, some lack one and some the other."""
    found = nearest_lookup(_shots(spark, d), _pixels(spark, d), "NDVI", *_GRID)
    return complete_rows(found, ["biomass", "NDVI"]).select("shot", "biomass", "NDVI")


@query("t7_climate", f"select shot, cast(trunc(v * 100) as smallint) BIO01, cast(trunc(w) as smallint) BIO12 from (select *, {_IY} iy, {_IX} ix from ({_SHOTS})) left join (select iy, ix, SR_B1 + 0.003::double v, NDVI * 7 w from ({_PIXELS})) using (iy, ix)")
def t7(spark, d):
    """BIO01 is kept in hundredths, BIO12 as it is; whole numbers are cut off, cells without data give NULL."""
    climate = _pixels(spark, d).select("iy", "ix", (F.col("SR_B1") + 0.003).alias("BIO01"), (F.col("NDVI") * 7).alias("BIO12"))
    return training.with_climate(_shots(spark, d), climate, ["BIO01", "BIO12"], *_GRID).select("shot", "BIO01", "BIO12")


_CODES = f"select iy, ix, case (iy * 20 + ix) % 9 when 0 then 0 when 1 then 241 else 40 + (iy + ix) % 4 end nlcd, cast((iy * 7 + ix) % 847 as int) ecoregion from ({_PIXELS})"


@query(
    "e2_land_cover",
    f"""select shot, g.ecoregion, case when nlcd not in (0, 241) then nlcd end nlcd, cast(null as int) eosd, l.igbp from (select shot, {_IY} iy, {_IX} ix, least(greatest(year(make_timestamp(time * 1000000)), 1995), 1997) as year from ({_SHOTS})) s
 left join ({_CODES}) g using (iy, ix) left join ({A.sql_landcover()}) l on l.iy = s.iy and l.ix = s.ix and l.year = s.year""",
)
def e2(spark, d):
    """Codes for no data become NULL, a layer that is not there gives NULL, and the yearly map is read at the acquisition's year."""
    i, j = F.col("iy"), F.col("ix")
    code = (i * 20 + j) % 9
    codes = _pixels(spark, d).select("iy", "ix", F.when(code == 0, 0).when(code == 1, 241).otherwise(40 + (i + j) % 4).alias("nlcd"), ((i * 7 + j) % 847).cast("int").alias("ecoregion"))
    shots = _shots(spark, d).drop("ecoregion").withColumn("year", F.year(F.timestamp_seconds("time")))
    layers = {"ecoregion": codes, "nlcd": codes, "igbp": A.landcover(spark, d)}
    return training.with_land_cover(shots, layers, *_GRID, years=(1995, 1997)).select("shot", "ecoregion", "nlcd", "eosd", "igbp")


@query("d15_first_burn", "select l_partkey, min(case when n > 0 then year * 1000 + n end) first_burn from (select l_partkey, year(l_shipdate) as year, (l_orderkey % 300 - 2) n from lineitem) group by 1")
def d15(spark, d):
    li = A.read(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), (F.col("l_orderkey") % 300 - 2).alias("burn_date"))
    return training.first_burn(li, ["l_partkey"])


@query("d26_mean_of_totals", "select l_returnflag, round(avg(total), 4) mean_total from (select l_returnflag, l_shipdate, sum(floor(l_quantity)) total from lineitem group by all) group by 1")
def d26(spark, d):
    li = A.read(spark, d, "lineitem").withColumn("q", F.floor("l_quantity"))
    return training.mean_of_totals(li, "l_shipdate", "q", ["l_returnflag"]).select("l_returnflag", F.round("mean_total", 4).alias("mean_total"))


@query("m12_units", "select shot, round(biomass / 1e6, 9) megatonnes, round(biomass * 3.664, 6) co2, round(biomass / 0.47, 6) dry_mass from (" + _SHOTS + ") where biomass is not null")
def m12(spark, d):
    b = F.col("biomass")
    rows = _shots(spark, d).where(b.isNotNull())
    return rows.select("shot", F.round(training.megatonnes(b), 9).alias("megatonnes"), F.round(training.carbon_to_co2(b), 6).alias("co2"), F.round(training.carbon_to_biomass(b), 6).alias("dry_mass"))


@query("b12_valid_records", "select vec_id from embeddings where vec_id % 5 > 0 and list_max(embedding) < 0.3")
def b12(spark, d):
    """Bins of 0.3 and more, and all of every fifth record, are set to the fill value."""
    e = A.read(spark, d, "embeddings")
    filled = F.transform("embedding", lambda x: F.when((x >= 0.3) | (F.col("vec_id") % 5 == 0), F.lit(1.7e38)).otherwise(x.cast("double")))
    return training.valid_records(e.select("vec_id", filled.alias("rec_wf"))).select("vec_id")


@query("b17_quality_flag", "select vec_id from embeddings where label % 2 = 1")
def b17(spark, d):
    return training.good_shots(A.read(spark, d, "embeddings").withColumn("quality_flag", F.col("label") % 2)).select("vec_id")


@query("t8_tropical_zones", "select c_custkey, zone from (select c_custkey, case c_custkey % 4 when 0 then 'Tropical dry forest' when 1 then 'Subtropical steppe' when 2 then 'Tropical' end zone from customer) where zone like 'Tropical%'")
def t8(spark, d):
    k = F.col("c_custkey")
    zones = A.read(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, "Tropical dry forest").when(k % 4 == 1, "Subtropical steppe").when(k % 4 == 2, "Tropical").alias("zone"))
    return training.tropical_zones(zones, "zone")


@query("h2_acquisition_time", "select event_id, timestamp '2000-01-01 12:00:00' + case when event_id % 7 > 0 then to_seconds(event_id * 977) else interval 0 second end acquired from events")
def h2(spark, d):
    e = A.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 > 0, F.col("event_id") * 977).alias("seconds"))
    return e.select("event_id", training.acquisition_time(F.col("seconds")).cast("timestamp_ntz").alias("acquired"))


@query("l14_parquet_urls", "select l_orderkey, l_linenumber, 's3://bucket/training/' || (l_partkey % 233) || '/' || (l_suppkey % 248) || '/' || year(l_shipdate) || '/data.parquet' url from lineitem")
def l14(spark, d):
    li = A.read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", training.parquet_url("s3://bucket/training", F.col("l_partkey") % 233, F.col("l_suppkey") % 248, F.year("l_shipdate")).alias("url"))


# The transverse Mercator projection once more, from the series in the eccentricity (another expansion than the operator's).
_UTM = """select *, 500000 + 0.9996 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120) east,
 0.9996 * (m + n * tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720)) north from (
 select *, 6378137.0::double / sqrt(1 - e2 * sin(phi)**2) n, tan(phi)**2 t, ep * cos(phi)**2 c, cos(phi) * radians(lon + 123) a,
 6378137.0::double * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * sin(4 * phi) - 35 * e2**3 / 3072 * sin(6 * phi)) m from (
 select *, radians(lat) phi, e2 / (1 - e2) ep from (select c_custkey, 45.0::double + (c_custkey % 997) / 997.0::double lat, -124.0::double + (c_custkey % 991) / 991.0::double * 2 lon, 0.0066943799901413165::double e2 from customer)))"""


@query("j9_reproject_scene", f"select c_custkey, r * 100 + c as value from (select c_custkey, cast(floor((east - 430000) / 3000.0::double + 0.5) as int) c, cast(floor((5094000 - north) / 3000.0::double + 0.5) as int) r from ({_UTM})) where r between 0 and 29 and c between 0 and 39")
def j9(spark, d):
    """A scene of 30 x 40 pixels of 3 km in UTM zone 10, read at the places of customers."""
    k = F.col("c_custkey")
    places = A.read(spark, d, "customer").select("c_custkey", (F.lit(45.0) + (k % 997) / 997.0).alias("lat"), (F.lit(-124.0) + (k % 991) / 991.0 * 2).alias("lon"), F.lit(10).alias("zone"))
    scene = spark.range(1200).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"))
    scene = scene.withColumn("value", (F.col("row") * 100 + F.col("col")).cast("double"))
    return training.reproject_scene(places, scene, "value", 430000.0, 5094000.0, 3000.0).select("c_custkey", F.col("value").cast("int").alias("value"))
