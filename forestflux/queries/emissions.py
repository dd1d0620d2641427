"""Emission, fire, pool and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import box_ring
from ..functions.grid import cell_area_ha
from ..operators import aggregate, dissolve, emissions, fire, joins, polygons, timeseries
from ..plans import pipelines
from ..sources import adapters as A
from .registry import query

_AREA = "(6.371e6::double * 6.371e6::double * abs(radians(0.25::double) * radians(0.25::double)) / 10000.0::double) * cos(radians(lat))"
_EMISSIONS = f"select s.*, y.year, s.agb * (case when lossyear = y.year then 1.0::double else 0.0::double end) * 0.5::double * 3.67::double emissions from ({A.sql_static()}) s, (select unnest(range(2001, 2008)) as year) y"
_FIRE = f"""select e.*, coalesce(b.hit, 0) hit, (coalesce(b.hit, 0) + lag(coalesce(b.hit, 0), 1, 0) over (partition by iy, ix order by e.year)) > 0 is_fire
 from ({_EMISSIONS}) e left join (select *, 1 hit from ({A.sql_burned()})) b using (ix, iy, year)"""


def _emissions(spark, d):
    return emissions.emissions_by_loss_year(A.static_raster(spark, d), 2001, 2007)


def _with_fire(spark, d):
    flags = A.burned(spark, d).withColumn("burned", F.lit(1))
    return timeseries.attribute_to_fire(_emissions(spark, d).join(flags, ["ix", "iy", "year"], "left"))


def _split(spark, d):
    df = A.with_position(emissions.split_by_fire(_with_fire(spark, d)))
    return df.withColumn("area", cell_area_ha(F.col("lat"), 0.25, 0.25))


_SPLIT = f"select *, {A.SQL_POSITION}, case when is_fire then emissions else 0.0 end emissions_fire, emissions - case when is_fire then emissions else 0.0 end emissions_clearing from ({_FIRE})"


@query(
    "d4_country_rollup",
    f"""with g as (select *, {_AREA} area from ({_SPLIT})), r as ({A.sql_regions()})
 select code, make_date(year, 1, 1) begin_date, make_date(year + 1, 1, 1) end_date, round(sum(emissions * area), 2) emissions, round(sum(emissions_fire * area), 2) emissions_fire
 from g join r on ix >= x0 and ix < x1 and iy >= y0 and iy < y1 group by code, year""",
)
def country_rollup(spark, d):
    """Loss-year emissions, weighted by cell area, summed per country polygon and year."""
    static, fire = A.with_position(A.static_raster(spark, d)), A.burned(spark, d).withColumn("burned", F.lit(1))
    out = pipelines.country_emissions(static, fire, A.regions(spark, d), 2001, 2007, 0.25)
    return out.select("code", "begin_date", "end_date", *[F.round(c, 2).alias(c) for c in ("emissions", "emissions_fire")])


@query("m1_emissions_by_loss_year", f"select ix, iy, year, round(emissions, 6) emissions from ({_EMISSIONS})")
def m1(spark, d):
    return _emissions(spark, d).select("ix", "iy", "year", F.round("emissions", 6).alias("emissions"))


@query("m13_tree_cover_emissions", f"select s.ix, s.iy, y.year, round(agb * (case when lossyear = y.year then ((ix + iy) % 101) / 100.0::double else 0.0::double end) * 0.5::double * 3.67::double, 6) emissions from ({A.sql_static()}) s, (select unnest(range(2001, 2008)) as year) y")
def m13(spark, d):
    s = A.static_raster(spark, d).withColumn("cover", ((F.col("ix") + F.col("iy")) % 101) / 100.0)
    return emissions.emissions_by_loss_year(s, 2001, 2007, tree_cover="cover").select("ix", "iy", "year", F.round("emissions", 6).alias("emissions"))


@query("m2_cell_area", f"select iy, round(max(area), 4) area from (select *, {_AREA} area from (select *, {A.SQL_POSITION} from ({A.sql_static()}))) group by iy")
def m2(spark, d):
    df = A.with_position(A.static_raster(spark, d)).withColumn("area", cell_area_ha(F.col("lat"), 0.25, 0.25))
    return df.groupBy("iy").agg(F.round(F.max("area"), 4).alias("area"))


@query("f2_fire_attribution", f"select ix, iy, year, is_fire from ({_FIRE})")
def f2(spark, d):
    return _with_fire(spark, d).select("ix", "iy", "year", "is_fire")


@query("m3_fire_split", f"select year, round(sum(emissions_fire), 4) emissions_fire, round(sum(emissions_clearing), 4) emissions_clearing, round(sum(emissions), 4) emissions from ({_SPLIT}) group by year")
def m3(spark, d):
    return _split(spark, d).groupBy("year").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("emissions_fire", "emissions_clearing", "emissions")])


@query("d1_coarsen_sum", f"with g as (select *, {_AREA} area from ({_SPLIT})) select iy // 4 iy, ix // 4 ix, year, round(coalesce(sum(emissions * case when hit > 0 then area end), 0), 3) emissions from g group by 1, 2, 3")
def d1(spark, d):
    df = _split(spark, d).withColumn("hit", F.when(F.col("burned") > 0, 1))
    return aggregate.coarsen_sum(df, "emissions", "area", 4, "hit").withColumn("emissions", F.round("emissions", 3))


@query("d2_coarsen_mean", f"with g as (select *, {_AREA} area from ({_SPLIT})) select iy // 4 iy, ix // 4 ix, year, round(coalesce(sum(emissions * case when hit > 0 then area end), 0) / nullif(sum(case when hit > 0 then area end), 0), 6) emissions from g group by 1, 2, 3")
def d2(spark, d):
    df = _split(spark, d).withColumn("hit", F.when(F.col("burned") > 0, 1))
    return aggregate.coarsen_mean(df, "emissions", "area", 4, "hit").withColumn("emissions", F.round("emissions", 6))


@query("d3_coarsen_trim", f"select iy // 3 iy, ix // 3 ix, year, round(avg(agb), 6) agb from ({A.sql_pixel_year()}) where iy < 18 and ix < 18 group by 1, 2, 3")
def d3(spark, d):
    return aggregate.coarsen_plain(A.pixel_year(spark, d), ["agb"], 3, "mean", (20, 20), ("year",)).withColumn("agb", F.round("agb", 6))


@query("d5_weighted_mean_by_country", f"with g as (select *, {_AREA} area from (select *, {A.SQL_POSITION} from ({A.sql_pixel_year()}))), r as ({A.sql_regions()}) select code, year, round(sum(case when ix % 3 > 0 then agb end * area) / nullif(sum(area), 0), 6) agb from g join r on ix >= x0 and ix < x1 and iy >= y0 and iy < y1 group by code, year")
def d5(spark, d):
    regions = A.regions(spark, d)
    df = A.with_position(A.pixel_year(spark, d)).withColumns({"area": cell_area_ha(F.lit(10.0) - (F.col("iy") + 0.5) / 4, 0.25, 0.25), "agb": F.when(F.col("ix") % 3 > 0, F.col("agb"))})
    masked = joins.polygon_mask(df, regions).join(F.broadcast(regions.select(F.col("id").alias("region"), "code")), "region")
    return aggregate.weighted_mean(masked, ["code", "year"], "agb", "area").withColumn("agb", F.round("agb", 6))


@query("d6_realm_rollup", f"with g as (select *, {_AREA} area from (select *, {A.SQL_POSITION} from ({A.sql_pixel_year()}))), r as ({A.sql_regions()}) select realm, year, round(sum(agb * area) / nullif(sum(area), 0), 6) agb from g join r on ix >= x0 and ix < x1 and iy >= y0 and iy < y1 group by realm, year")
def d6(spark, d):
    regions = A.regions(spark, d)
    df = A.with_position(A.pixel_year(spark, d)).withColumn("area", cell_area_ha(F.col("lat"), 0.25, 0.25))
    masked = joins.polygon_mask(df, regions).join(F.broadcast(regions.select(F.col("id").alias("region"), "realm")), "region")
    return aggregate.weighted_mean(masked, ["realm", "year"], "agb", "area").withColumn("agb", F.round("agb", 6))


@query("c6_polygon_mask", f"with r as ({A.sql_regions()}) select ix, iy, min(id) region from (select distinct ix, iy from ({A.sql_static(40)})) left join r on ix >= x0 and ix < x1 and iy >= y0 and iy < y1 group by ix, iy")
def c6(spark, d):
    layer = A.regions(spark, d).select("id", F.array("ring").alias("rings"))
    return polygons.mask(A.static_raster(spark, d, 40), layer, A.GRID).select("ix", "iy", "region")


#: A frame per nation: a rectangle with a rectangular hole, no side of which lies on a cell's edge.
_FRAMES = "select n_nationkey id, n_name code, (n_nationkey % 5) * 2.0::double - 0.07::double x0, (n_nationkey % 5) * 2.0::double + 1.56::double x1, 8.62::double - (n_nationkey // 5) * 2.0::double y0, 10.03::double - (n_nationkey // 5) * 2.0::double y1 from nation"


def _frames(spark, d):
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 2.0 - 0.07, F.lit(8.62) - F.floor(k / 5) * 2.0
    rings = F.array(box_ring(x0, y0, x0 + 1.63, y0 + 1.41), box_ring(x0 + 0.31, y0 + 0.31, x0 + 1.32, y0 + 1.1))
    return A.read(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("code"), rings.alias("rings"))


def _overlap(inset: float) -> str:
    side = lambda low, high, a, b: f"greatest(0.0::double, least({high} - {inset}::double, {b}) - greatest({low} + {inset}::double, {a}))"
    return f"{side('x0', 'x1', 'ix / 4.0::double', '(ix + 1) / 4.0::double')} * {side('y0', 'y1', '10 - (iy + 1) / 4.0::double', '10 - iy / 4.0::double')}"


@query(
    "d27_clipped_totals",
    f"with g as (select *, {_AREA} area from (select *, {A.SQL_POSITION} from ({A.sql_pixel_year(40)}))), f as ({_FRAMES}), s as (select *, ({_overlap(0.0)} - {_overlap(0.31)}) * 16 share from g, f)"
    " select code, year, round(sum(agb * area * share) / 1e6, 6) megatonnes, round(sum(area * share), 4) hectares from s where share > 0 group by code, year",
)
def d27(spark, d):
    """Totals of cells clipped to polygons with holes, by the share of each cell that is inside."""
    cells = A.with_position(A.pixel_year(spark, d, 40)).withColumn("area", cell_area_ha(F.col("lat"), 0.25, 0.25))
    layer = _frames(spark, d)
    found = polygons.clipped_sums(cells, layer, A.GRID, ["agb"], area="area", keys=("year",)).join(layer.select("id", "code"), "id")
    return found.select("code", "year", F.round(F.col("agb") / 1e6, 6).alias("megatonnes"), F.round("inside", 4).alias("hectares"))


@query(
    "c5_points_in_fine_rings",
    f"with n as (select n_nationkey k, n_name code, (n_nationkey % 5) * 2.0::double + 1.0131::double cx, 9.0171::double - (n_nationkey // 5) * 2.0::double cy from nation)"
    f" select code, count(*) n, round(sum(biomass), 3) biomass from ({A.SQL_POINTS}) join n on abs(x - cx) + abs(y - cy) < 0.9137::double and abs(x - cx) + abs(y - cy) >= 0.4219::double group by code",
)
def c5_fine(spark, d):
    """Points in diamonds with diamond holes, whose rings have 8000 and 400 vertices."""
    k = F.col("n_nationkey")
    cx, cy = (k % 5) * 2.0 + 1.0131, F.lit(9.0171) - F.floor(k / 5) * 2.0

    def diamond(radius: float, steps: int):
        def vertex(i):
            side, part = F.floor(i / steps), (i % steps) / float(steps)
            u, v = F.lit(radius) * (1 - part), F.lit(radius) * part
            x = F.when(side == 0, u).when(side == 1, -v).when(side == 2, -u).otherwise(v)
            y = F.when(side == 0, v).when(side == 1, u).when(side == 2, -v).otherwise(-u)
            return F.struct((cx + x).alias("x"), (cy + y).alias("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(4 * steps - 1)), vertex)

    layer = A.read(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("code"), F.array(diamond(0.9137, 2000), diamond(0.4219, 100)).alias("rings"))
    found = joins.points_in_polygons(A.points(spark, d), layer, "x", "y")
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("biomass"), 3).alias("biomass"))


@query(
    "j11_dissolved_realms",
    f"with r as ({A.sql_regions(40)}), c as (select realm, count(*) cells from (select distinct ix, iy from ({A.sql_static(40)})) join r on ix >= x0 and ix < x1 and iy >= y0 and iy < y1 group by realm),"
    " a as (select realm, sum((x1 - x0) * (y1 - y0)) / 16.0::double area from r group by realm) select realm, round(area, 9) area, cells from a join c using (realm)",
)
def j11(spark, d):
    """Regions dissolved by realm: the area and the cells of each realm are those of its regions together."""
    whole = dissolve.dissolve(A.regions(spark, d, 40).withColumn("rings", F.array("ring")), "realm")
    layer = whole.withColumn("id", F.col("realm"))  # the parts of a realm are parts of one polygon
    cells = polygons.cells_in_runs(A.static_raster(spark, d, 40).select("iy", "ix").distinct(), polygons.inside_runs(layer, A.GRID)).groupBy("id").agg(F.count(F.lit(1)).alias("cells"))
    area = polygons.share_runs(layer, A.GRID).groupBy("id").agg((F.sum(F.col("share") * (F.col("ix1") - F.col("ix0") + 1)) / 16).alias("area"))
    return area.join(cells, "id").select(F.col("id").alias("realm"), F.round("area", 9).alias("area"), "cells")


@query("c5_points_in_scenes", f"with r as ({A.sql_regions()}) select code, count(*) n, round(sum(biomass), 3) biomass from ({A.SQL_POINTS}) join r on floor(x * 4) >= x0 and floor(x * 4) < x1 and y < 10 - y0 / 4.0 and y >= 10 - y1 / 4.0 group by code")
def c5(spark, d):
    """Points at multiples of 1/40 degree; edges belong to the polygon above and to the right of them."""
    found = joins.points_in_polygons(A.points(spark, d), A.regions(spark, d), "x", "y")
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("biomass"), 3).alias("biomass"))


_DEAD = """case when is_tropics and elevation < 2000 and precipitation < 1000 then {0} when is_tropics and elevation < 2000 and precipitation < 1600 then {1}
 when is_tropics and elevation < 2000 and precipitation >= 1600 then {2} when is_tropics and elevation >= 2000 then {3} when not is_tropics then {4} else 0.0 end"""
_POOLS = f"select *, 0.489::double * pow(agb, 0.890::double) bgb, agb * {_DEAD.format(0.02, 0.01, 0.06, 0.07, 0.08)} dead_wood, agb * {_DEAD.format(0.04, 0.01, 0.01, 0.01, 0.04)} litter from ({A.sql_pools_input()})"


@query("m8_m9_carbon_pools", f"select ix, iy, year, round(bgb, 6) bgb, round(dead_wood, 6) dead_wood, round(litter, 6) litter from ({_POOLS})")
def m8(spark, d):
    return emissions.carbon_pools(A.pools_input(spark, d)).select("ix", "iy", "year", *[F.round(c, 6).alias(c) for c in ("bgb", "dead_wood", "litter")])


def _flux(spark, d):
    df = emissions.carbon_pools(A.pools_input(spark, d))
    df = timeseries.losses(df, list(emissions.POOLS))
    flags = A.burned(spark, d).withColumn("burned", F.lit(1))
    df = timeseries.attribute_to_fire(df.join(flags, ["ix", "iy", "year"], "left"))
    df = df.join(A.landcover(spark, d), ["ix", "iy", "year"], "left")
    return emissions.flux_emissions(emissions.split_pools_by_fire(df))


_LOSS = f"select *, {', '.join(f'lag({p}) over w - {p} d_{p}' for p in ('agb', 'bgb', 'dead_wood', 'litter'))}, min(year) over (partition by iy, ix) y0 from ({_POOLS}) window w as (partition by iy, ix order by year)"
_LOSS_FIRE = f"""select l.*, igbp, (coalesce(b.hit, 0) + lag(coalesce(b.hit, 0), 1, 0) over (partition by iy, ix order by year)) > 0 is_fire from (select * from ({_LOSS}) where year > y0) l
 left join (select *, 1 hit from ({A.sql_burned()})) b using (ix, iy, year) left join ({A.sql_landcover()}) using (ix, iy, year)"""


def _pos(p):
    return f"case when d_{p} is not null then greatest(d_{p}, 0) end"


def _neg(p):
    return f"case when d_{p} is not null then least(d_{p}, 0) end"


_CO2 = {"agb": 0.47, "bgb": 0.47, "dead_wood": 0.47, "litter": 0.37}
_FLUX = f"""select *, coalesce(case when is_fire then {_pos('agb')} + {_pos('bgb')} else 0.0 end * case when igbp in (8, 9) then 1.613 when is_tropics then 1.580 else 1.569 end, 0.0) emissions_from_fire,
 {' + '.join(f"(case when not is_fire then {_pos(p)} else 0.0 end) * {f}::double * 3.67::double" for p, f in _CO2.items())} emissions_from_clearing,
 {' + '.join(f"({_neg(p)}) * {f}::double * 3.67::double" for p, f in _CO2.items())} sinks from ({_LOSS_FIRE})"""


@query("f3_biomass_change", f"select ix, iy, year, {', '.join(f'round(d_{p}, 6) d_{p}' for p in _CO2)} from ({_LOSS}) where year > y0")
def f3(spark, d):
    df = timeseries.losses(emissions.carbon_pools(A.pools_input(spark, d)), list(emissions.POOLS))
    return df.select("ix", "iy", "year", *[F.round(f"d_{p}", 6).alias(f"d_{p}") for p in emissions.POOLS])


@query("m4_m7_flux", f"select ix, iy, year, round(emissions_from_fire, 5) emissions_from_fire, round(emissions_from_clearing, 5) emissions_from_clearing, round(sinks, 5) sinks, round(emissions_from_fire + emissions_from_clearing + sinks, 5) net from ({_FLUX})")
def m4(spark, d):
    return _flux(spark, d).select("ix", "iy", "year", *[F.round(c, 5).alias(c) for c in ("emissions_from_fire", "emissions_from_clearing", "sinks", "net")])


@query("d4_flux_rollup", f"with r as ({A.sql_regions()}) select code, make_date(year, 1, 1) begin_date, make_date(year + 1, 1, 1) end_date, round(sum(emissions_from_fire + emissions_from_clearing + sinks), 3) net from ({_FLUX}) f join r on ix >= x0 and ix < x1 and iy >= r.y0 and iy < y1 group by code, year")
def d4_flux(spark, d):
    regions = A.regions(spark, d)
    masked = joins.polygon_mask(A.with_position(_flux(spark, d)), regions)
    return aggregate.regional_totals(masked, F.broadcast(regions.select(F.col("id").alias("region"), "code")), ["net"]).withColumn("net", F.round("net", 3))


@query("m10_forest_mask", f"with f as (select ix, iy, bool_or(igbp in (1, 2, 3, 4, 5, 8, 9)) ok from ({A.sql_landcover(40)}) group by ix, iy) select ix, iy, year, case when ok then agb end agb from ({A.sql_pixel_year(40)}) left join f using (ix, iy)")
def m10(spark, d):
    return emissions.forest_mask(A.pixel_year(spark, d, 40), A.landcover(spark, d, 40), ["agb"]).select("ix", "iy", "year", "agb")


@query("m11_result_mask", f"with f as (select ix, iy, bool_or(igbp > 0) ok from ({A.sql_landcover(40)}) group by ix, iy) select p.ix, p.iy, p.year, case when ok and v.ix is not null then agb end agb from ({A.sql_pixel_year(40)}) p left join f using (ix, iy) left join (select distinct ix, iy from ({A.sql_burned(40)})) v using (ix, iy)")
def m11(spark, d):
    return emissions.result_mask(A.pixel_year(spark, d, 40), A.landcover(spark, d, 40), A.burned(spark, d, 40), ["agb"]).select("ix", "iy", "year", "agb")


@query("m14_web_variables", f"select ix, iy, year, round(coalesce(emissions_from_fire + emissions_from_clearing, 0), 4) emissions, round(coalesce(sinks, 0), 4) sinks, round(coalesce(emissions_from_fire + emissions_from_clearing + sinks, 0), 4) net from ({_FLUX})")
def m14(spark, d):
    total = F.col("emissions_from_fire") + F.col("emissions_from_clearing")
    return _flux(spark, d).select("ix", "iy", "year", F.round(F.coalesce(total, F.lit(0.0)), 4).alias("emissions"), F.round(F.coalesce("sinks", F.lit(0.0)), 4).alias("sinks"), F.round(F.coalesce("net", F.lit(0.0)), 4).alias("net"))


@query("m15_pyramid", f"select cast(l as int) as level, cast(floor(iy / pow(2, l)) as int) iy, cast(floor(ix / pow(2, l)) as int) ix, round(avg(agb), 6) agb from ({A.sql_pixel_year(40)}), range(6) t(l) group by all")
def m15(spark, d):
    return aggregate.pyramid(A.pixel_year(spark, d, 40), "agb", 6).withColumn("agb", F.round("agb", 6))


_DISCS = f"select year, (lon - 0) / 0.05::double x, (20.0::double - lat) / 0.05::double y, 9000.0::double / (110574.2727::double * cos(radians(lat))) / 0.05::double r from ({A.SQL_FIRE_POINTS}) where confidence in ('n', 'h')"
_CELLS = f"""select distinct year, cast(cy as int) iy, cast(cx as int) ix from (select distinct * from ({_DISCS})), (select unnest(range(-2, 4)) a), (select unnest(range(-2, 4)) b), lateral (select floor(x) + a cx, floor(y) + b cy)
 where cx between 0 and 799 and cy between 0 and 399 and pow(greatest(cx - x, 0, x - cx - 1), 2) + pow(greatest(cy - y, 0, y - cy - 1), 2) <= r * r"""


@query("v2_burn_cells", _CELLS)
def v2(spark, d):
    """Discs of 9 km on a 0.05-degree grid, so that each covers several cells."""
    return fire.burn_cells(fire.detections(A.fire_points(spark, d), 9000.0), 0.0, 20.0, 0.05, 400, 800)


_NEAR = f"select year, lon / 0.0025::double x, (20.0::double - lat) / 0.0025::double y, 375.0::double / (110574.2727::double * cos(radians(lat))) / 0.0025::double r from ({A.SQL_FIRE_POINTS}) where confidence in ('n', 'h')"


@query(
    "v2_burn_cells_375m",
    f"""select distinct year, cast(cy as int) iy, cast(cx as int) ix from (select distinct * from ({_NEAR})), (select unnest(range(-2, 4)) a), (select unnest(range(-2, 4)) b), lateral (select floor(x) + a cx, floor(y) + b cy)
 where cx between 0 and 15999 and cy between 0 and 7999 and pow(greatest(cx - x, 0, x - cx - 1), 2) + pow(greatest(cy - y, 0, y - cy - 1), 2) <= r * r""",
)
def v2_near(spark, d):
    """Discs of the sensor's 375 m on a grid of 0.0025 degrees."""
    return fire.burn_cells(fire.detections(A.fire_points(spark, d)), 0.0, 20.0, 0.0025, 8000, 16000)


@query("v4_burned_fraction", f"select year, iy // 10 iy, ix // 10 ix, count(*) / 100.0::double burned from ({_CELLS}) group by 1, 2, 3")
def v4(spark, d):
    cells = fire.burn_cells(fire.detections(A.fire_points(spark, d), 9000.0), 0.0, 20.0, 0.05, 400, 800)
    return fire.burned_fraction(cells, 10)


@query("v1_fire_buffer", f"select confidence, lat, count(*) n, round(max(375.0::double / (110574.2727::double * cos(radians(lat)))), 9) radius from ({A.SQL_FIRE_POINTS}) where confidence in ('n', 'h') group by 1, 2")
def v1(spark, d):
    return fire.detections(A.fire_points(spark, d)).groupBy("confidence", "lat").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("radius"), 9).alias("radius"))
