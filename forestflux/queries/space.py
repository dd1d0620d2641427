"""Resampling, projections and scenes over inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid
from ..operators import regrid, scenes
from ..operators.polygons import Grid
from ..sources import adapters as A
from .registry import query

# ---------------------------------------------------------------- conservative resampling

#: Three cells of the quarter-degree grid on two of this one, shifted, so that nothing nests; it covers all of it.
_COARSE = Grid(west=-0.3, north=10.2, step=0.375, nlat=28, nlon=28)
_OVERLAP = """greatest(0.0::double, least((ix + 1) / 4.0::double, -0.3::double + (jx + 1) * 0.375::double) - greatest(ix / 4.0::double, -0.3::double + jx * 0.375::double))"""
_OVERLAP_Y = """greatest(0.0::double, least(10 - iy / 4.0::double, 10.2::double - jy * 0.375::double) - greatest(10 - (iy + 1) / 4.0::double, 10.2::double - (jy + 1) * 0.375::double))"""
_AXES = f"tx as (select ix, jx, {_OVERLAP} w from range(40) a(ix), range(28) b(jx)), ty as (select iy, jy, {_OVERLAP_Y} h from range(40) a(iy), range(28) b(jy))"


@query("d28_conservative_sum", f"with {_AXES}, g as ({A.sql_pixel_year(40)}) select cast(jy as int) iy, cast(jx as int) ix, year, round(sum(agb * w * h * 16), 6) agb from g join tx using (ix) join ty using (iy) where w > 1e-9 and h > 1e-9 group by all")
def d28(spark, d):
    return regrid.regrid(A.pixel_year(spark, d, 40), A.GRID, _COARSE, ["agb"], keys=("year",)).withColumn("agb", F.round("agb", 6))


@query("d28_total_kept", f"select year, round(sum(agb), 5) before, round(sum(agb), 5) after_ from ({A.sql_pixel_year(40)}) group by year")
def d28_total(spark, d):
    """Totals per year before and after two resamplings, there and back."""
    cells = A.pixel_year(spark, d, 40)
    there = regrid.regrid(cells, A.GRID, _COARSE, ["agb"], keys=("year",))
    back = regrid.regrid(there, _COARSE, Grid(west=-1.0, north=11.0, step=0.25, nlat=48, nlon=48), ["agb"], keys=("year",))
    total = lambda df, name: df.groupBy("year").agg(F.round(F.sum("agb"), 5).alias(name))
    return total(cells, "before").join(total(back, "after_"), "year")


@query(
    "t10_mean_in_tiles",
    f"""with tx as (select ix, jx, greatest(0.0::double, least((ix + 1) / 4.0::double, (jx + 1) * 0.4::double) - greatest(ix / 4.0::double, jx * 0.4::double)) w from range(40) a(ix), range(25) b(jx)),
 ty as (select iy, jy, greatest(0.0::double, sin(radians(least(10 - iy / 4.0::double, 10 - jy * 0.4::double))) - sin(radians(greatest(10 - (iy + 1) / 4.0::double, 10 - (jy + 1) * 0.4::double)))) h from range(40) a(iy), range(25) b(jy)),
 g as (select ix, iy, year, case when (ix + iy) % 5 > 0 then agb end agb from ({A.sql_pixel_year(40)})),
 m as (select jy, jx, year, sum(agb * w * h) / nullif(sum(case when agb is not null then w * h end), 0) agb from g join tx using (ix) join ty using (iy) where w > 1e-9 and h > 1e-9 group by all)
 select printf('%02dN_%03dE', 10 - (jy // 5) * 2, (jx // 5) * 2) tile_id, cast(jy % 5 as int) iy, cast(jx % 5 as int) ix, year, round(agb, 6) agb from m""",
)
def t10(spark, d):
    """The quarter-degree cells on a grid of 0.4 degrees, by shared area on the sphere, cut into tiles of two degrees."""
    cells = A.pixel_year(spark, d, 40).withColumn("agb", F.when((F.col("ix") + F.col("iy")) % 5 > 0, F.col("agb")))
    target = Grid(west=0.0, north=10.0, step=0.4, nlat=25, nlon=25)
    means = regrid.regrid(cells, A.GRID, target, ["agb"], how="mean", keys=("year",), sphere=True)
    return regrid.into_tiles(means, target, size=2).select("tile_id", "iy", "ix", "year", F.round("agb", 6).alias("agb"))


# ---------------------------------------------------------------- projections

#: Places of customers all over the zones, in hundredths of a degree.
_PLACES = "select c_custkey, (c_custkey * 7919 % 16401 - 8000) / 100.0::double lat, (c_custkey * 104729 % 36000 - 18000) / 100.0::double lon from customer"


def _places(spark, d):
    k = F.col("c_custkey").cast("long")
    return A.read(spark, d, "customer").select("c_custkey", ((k * 7919 % 16401 - 8000) / 100.0).alias("lat"), ((k * 104729 % 36000 - 18000) / 100.0).alias("lon"))


@query("j10_there_and_back", f"select c_custkey, round(lat, 8) lat, round(lon, 8) lon, cast(floor((lon + 180) / 6) + 1 as int) as zone, substr('CDEFGHJKLMNPQRSTUVWX', least(floor((lat + 80) / 8), 19)::int + 1, 1) letter, true as within_a_millimetre from ({_PLACES})")
def j10(spark, d):
    """Places projected to their zone and back: they come out as they went in, to 1e-8 degrees (a millimetre)."""
    p = _places(spark, d).withColumn("zone", grid.utm_zone(F.col("lon")))
    east, north = grid.utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    p = p.withColumns({"east": east, "north": north})
    lat, lon = grid.utm_inverse(F.col("east"), F.col("north"), F.col("zone"))
    near = (F.abs(lat - F.col("lat")) < 9e-9) & (F.abs(lon - F.col("lon")) * F.cos(F.radians("lat")) < 9e-9)
    return p.select("c_custkey", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"), "zone", grid.utm_band(F.col("lat")).alias("letter"), near.alias("within_a_millimetre"))


_BANDS = "select c_custkey, lat a, lat + (c_custkey % 9) * 0.5::double b from (select c_custkey, c_custkey % 160 - 80 lat from customer)"


@query("j7_spans_band_edge", f"select c_custkey, (select count(*) from (select unnest(range(-80, 80, 8)) e union all select 84) where (e > a and e < b) or (e = a and e = b)) > 0 spans from ({_BANDS})")
def j7_spans(spark, d):
    k = F.col("c_custkey")
    a = (k % 160 - 80).cast("double")
    return A.read(spark, d, "customer").select("c_custkey", grid.spans_band_edge(a, a + (k % 9) * 0.5).alias("spans"))


@query("j7_zone_letter", f"select c_custkey, substr('CDEFGHJKLMNPQRSTUVWX', least(floor((case when (select count(*) from (select unnest(range(-80, 80, 8)) e union all select 84) where e > lat - 1.5 and e < lat) > 0 and c_custkey % 5 = 0 then lat - 1.5 else lat end + 80) / 8), 19)::int + 1, 1) letter from ({_PLACES}) where lat > -78")
def j7_letter(spark, d):
    """Scenes of 1.5 degrees south and 1 west of places; of every fifth the upper right corner is 3 m off, so that the lower left decides."""
    p = _places(spark, d).where("lat > -78").withColumn("zone", grid.utm_zone(F.col("lon")))
    for c, (dy, dx) in {"ur": (0, 0), "ll": (1.5, 1), "ul": (0, 1), "lr": (1.5, 0)}.items():
        p = p.withColumns({f"{c}_lat": F.col("lat") - dy, f"{c}_lon": F.col("lon") - dx})
        east, north = grid.utm_forward(F.col(f"{c}_lat"), F.col(f"{c}_lon"), F.col("zone"))
        south = F.when((F.col(f"{c}_lat") < 0) & (F.col("c_custkey") % 2 == 0), F.lit(grid.FALSE_NORTHING)).otherwise(0.0)
        p = p.withColumns({f"{c}_x": east + F.when(F.col("c_custkey") % 5 == 0, 3.0 if c == "ur" else 0.0).otherwise(0.0), f"{c}_y": north + south})
    return p.select("c_custkey", scenes.zone_letter(F.col("zone")).alias("letter"))


# ---------------------------------------------------------------- scenes

# The projection from the series in the eccentricity (another expansion than the operator's), around the meridian of a zone.
_FORWARD = """select *, 500000 + 0.9996 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120) east,
 0.9996 * (m + n * tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720)) north from (
 select *, 6378137.0::double / sqrt(1 - e2 * sin(phi)**2) n, tan(phi)**2 t, ep * cos(phi)**2 c, cos(phi) * radians(dlon) a,
 6378137.0::double * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * sin(4 * phi) - 35 * e2**3 / 3072 * sin(6 * phi)) m from (
 select *, radians(lat) phi, e2 / (1 - e2) ep from (select *, 0.0066943799901413165::double e2 from ({}))))"""
# Scenes of 40 x 40 pixels of 4 km: one in zone 1 that begins west of 180 degrees, one in zone 60 that ends east of it, one inside zone 33 in the south.
_SCENES = "(values (0, 1, false, 270000.0::double, 6900000.0::double), (1, 60, false, 560000.0::double, 7200000.0::double), (2, 33, true, 450000.0::double, 8600000.0::double)) s(scene_id, zone, south, east0, north0)"
_CELLS = f"""select s.*, iy, ix, 90.0::double - (iy + 0.5::double) * 0.05::double lat, (ix + 0.5::double) * 0.05::double - 180 lon,
 ((ix + 0.5::double) * 0.05::double - 180 - (zone * 6 - 183) + 540) % 360 - 180 dlon from {_SCENES}, range(3600) y(iy), range(7200) x(ix)
 where iy between case when south then 1950 else 400 end and case when south then 2250 else 700 end and abs(((ix + 0.5::double) * 0.05::double - 180 - (zone * 6 - 183) + 540) % 360 - 180) < 15"""


@query(
    "j9_scenes_on_world_grid",
    f"""with p as (select cast(l_linenumber % 3 as int) scene_id, cast(l_partkey % 40 as int) pr, cast(l_suppkey % 40 as int) pc, avg(l_quantity) v from lineitem group by all),
 t as (select *, cast(floor((east - east0) / 4000.0::double + 0.5) as int) pc, cast(floor((north0 - north - case when south then 1e7 else 0 end) / 4000.0::double + 0.5) as int) pr from ({_FORWARD.format(_CELLS)}))
 select t.scene_id, case when scene_id = 2 then 'whole' when lon > 0 then 'east' else 'west' end side, cast(iy as int) iy, cast(ix as int) ix, round(case when v < 27 then v end, 6) v from t join p using (scene_id, pr, pc)""",
)
def j9_scenes(spark, d):
    """Line items as pixels of three scenes, two of which reach over the antimeridian, on a grid of a twentieth of a degree."""
    li = A.read(spark, d, "lineitem")
    pixels = li.groupBy((F.col("l_linenumber") % 3).cast("int").alias("scene_id"), (F.col("l_partkey") % 40).cast("int").alias("row"), (F.col("l_suppkey") % 40).cast("int").alias("col")).agg(F.avg("l_quantity").alias("v"))
    layout = spark.createDataFrame([(0, 1, False, 270000.0, 6900000.0), (1, 60, False, 560000.0, 7200000.0), (2, 33, True, 450000.0, 8600000.0)], "scene_id int, zone int, south boolean, east0 double, north0 double")
    layout = layout.withColumns({"step": F.lit(4000.0), "nrow": F.lit(40), "ncol": F.lit(40)})
    return scenes.reproject(pixels, layout, ["v"], step=0.05, no_data=27.0).select("scene_id", "side", "iy", "ix", F.round("v", 6).alias("v"))
