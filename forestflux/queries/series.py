"""Time-series, composite and tabular queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.nulls import clip, safe_div
from ..operators import aggregate, filters, joins, landsat, ranks, setops, timeseries
from ..sources import adapters as A
from ..sources import catalog
from .registry import query

_PY = A.sql_pixel_year()
_LINE = """select iy, ix, list(agb order by year) v from ({}) group by iy, ix having count(*) = 7"""


def _fit_sql(v: str, low: int, high: int) -> tuple[str, str]:
    n = high - low
    mean = f"(({' + '.join(f'{v}[{i + 1}]' for i in range(low, high))}) / {n}.0::double)"
    if n == 1:
        return "0.0::double", mean
    centre = sum(range(low, high)) / n
    sxx = sum((i - centre) ** 2 for i in range(low, high))
    slope = "((" + " + ".join(f"({i - centre}::double * ({v}[{i + 1}] - {mean}))" for i in range(low, high)) + f") / {sxx}::double)"
    return slope, f"({mean} - {slope} * {centre}::double)"


def _change_sql() -> str:
    pieces = [(0, 7), *[(0, k) for k in range(1, 7)], *[(k, 7) for k in range(1, 7)]]
    fits = ", ".join(f"{s} m{a}{b}, {c} c{a}{b}" for a, b in pieces for s, c in [_fit_sql("v", a, b)])
    mean = f"(({' + '.join(f'v[{i}]' for i in range(1, 8))}) / 7.0::double)"
    sq = lambda e: f"({e}) * ({e})"
    rss = ", ".join(("0.0::double" if b - a == 1 else " + ".join(sq(f"c{a}{b} + m{a}{b} * {i}.0::double - v[{i + 1}]") for i in range(a, b))) + f" r{a}{b}" for a, b in pieces)
    tss = " + ".join(sq(f"v[{i + 1}] - mean") for i in range(7))
    fs = ", ".join(f"((r07 - (r0{k} + r{k}7)) / 2.0::double) / nullif((r0{k} + r{k}7) / 3.0::double, 0) f{k}" for k in range(1, 7))
    best = "case " + " ".join(f"when f{k} = max_f then {k}" for k in range(1, 7)) + " end"
    two = "case bp " + " ".join(f"when {k} then r0{k} + r{k}7" for k in range(1, 7)) + " end"
    pi = "(2 / 3.141592653589793::double)"
    return f"""with a as ({_LINE.format(_PY)}), b as (select *, {fits}, {mean} mean from a), c as (select *, {rss}, {tss} tss from b), d as (select *, {fs} from c), e as (select *, greatest(f1, f2, f3, f4, f5, f6) max_f from d),
 g as (select *, case when max_f > 11.81 then {best} end bp from e), h as (select *, {two} two, greatest((tss - r07) / nullif(r07 / 5.0::double, 0), 0) f15, greatest((tss - ({two})) / 3.0::double / nullif(({two}) / 3.0::double, 0), 0) f33 from g)
 select iy, ix, bp as breakpoint, round(max_f, 3) max_f, round(case when bp is not null then 1 - {pi} * (asin(sqrt(f33 / (1 + f33))) - sqrt(f33 / (1 + f33) * (1 - f33 / (1 + f33))) * (1 - 2 * f33 / (1 + f33)))
 else 1 - {pi} * (atan(sqrt(f15 / 5)) + sin(atan(sqrt(f15 / 5))) * (cos(atan(sqrt(f15 / 5))) + 2.0::double / 3 * pow(cos(atan(sqrt(f15 / 5))), 3))) end, 5) pvalue from h"""


@query("n4_change_points", _change_sql())
def n4(spark, d):
    df = timeseries.change_points(A.pixel_year(spark, d), strict=False)
    return df.select("iy", "ix", "breakpoint", F.round("max_f", 3).alias("max_f"), F.round("pvalue", 5).alias("pvalue"))


@query("n5_smoothed_series")
def n5(spark, d):
    """The predictions of the chosen models, one row per pixel and year (checked against the fits in the tests)."""
    df = timeseries.change_points(A.pixel_year(spark, d), strict=False)
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return rows.select("iy", "ix", (1995 + F.col("i")).alias("year"), F.get("prediction", F.col("i")).alias("agb"))


@query("n1_linear_regression", f"select iy, ix, round(case when count(*) = 1 then 0 else regr_slope(agb, year) end, 6) slope, round(case when count(*) = 1 then 0 else greatest(regr_syy(agb, year) - regr_sxy(agb, year) * regr_sxy(agb, year) / nullif(regr_sxx(agb, year), 0), 0) end + 0.0013, 2) rss from ({A.sql_pixel_year(80)}) group by iy, ix")
def n1(spark, d):
    df = timeseries.linear_regression(A.pixel_year(spark, d, 80), ["iy", "ix"], "year", "agb")
    return df.select("iy", "ix", F.round("slope", 6).alias("slope"), F.round(F.col("rss") + 0.0013, 2).alias("rss"))


@query("f4_growth", f"select iy, ix, year, round(agb - lag(agb) over w, 6) as change, round((agb - lag(agb) over w) / nullif(lag(agb) over w, 0) * 100, 6) change_pct from ({_PY}) window w as (partition by iy, ix order by year)")
def f4(spark, d):
    return timeseries.growth(A.pixel_year(spark, d), "agb").select("iy", "ix", "year", F.round("change", 6).alias("change"), F.round("change_pct", 6).alias("change_pct"))


@query("f10_z_scores", f"select iy, ix, year, round((agb - avg(agb) over w) / nullif(stddev_pop(agb) over w, 0), 5) z from ({A.sql_pixel_year(40)}) window w as (partition by iy, ix)")
def f10(spark, d):
    return timeseries.z_scores(A.pixel_year(spark, d, 40), "agb").select("iy", "ix", "year", F.round("z", 5).alias("z"))


_SPARSE = f"select g.iy, g.ix, y.year, p.agb from (select distinct iy, ix from ({A.sql_pixel_year(40)})) g cross join (select unnest(range(1995, 2002)) as year) y left join (select * from ({A.sql_pixel_year(40)}) where (ix * 3 + iy + year) % 4 > 0) p on p.iy = g.iy and p.ix = g.ix and p.year = y.year"


def _sparse(spark, d):
    p = A.pixel_year(spark, d, 40)
    cells = p.select("iy", "ix").distinct().withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    return cells.join(p.where((F.col("ix") * 3 + F.col("iy") + F.col("year")) % 4 > 0), ["iy", "ix", "year"], "left")


def _fill_sql(source: str, keys: str, axis: str) -> str:
    return f"""select iy, ix, year, case when agb is not null then agb when n = 0 then null when n = 1 then o[1].v when pt is null then o[1].v + (o[2].v - o[1].v) * ({axis} - o[1].t) / (o[2].t - o[1].t)
 when nt is null then o[-2].v + (o[-1].v - o[-2].v) * ({axis} - o[-2].t) / (o[-1].t - o[-2].t) else pv + (nv - pv) * ({axis} - pt) / (nt - pt) end agb from
 (select *, count(agb) over (partition by {keys}) n, last_value(case when agb is not null then {axis} end ignore nulls) over b pt, last_value(agb ignore nulls) over b pv,
 first_value(case when agb is not null then {axis} end ignore nulls) over f nt, first_value(agb ignore nulls) over f nv from ({source})
 window b as (partition by {keys} order by {axis} rows between unbounded preceding and current row), f as (partition by {keys} order by {axis} rows between current row and unbounded following)) s
 left join (select {keys}, list({{'t': {axis}::double, 'v': agb}} order by {axis}) o from ({source}) where agb is not null group by {keys}) using ({keys})"""


@query("f6_fill_years", f"select iy, ix, year, round(agb, 5) agb from ({_fill_sql(_SPARSE, 'iy, ix', 'year')})")
def f6(spark, d):
    return timeseries.fill_axis(_sparse(spark, d), "agb", ["iy", "ix"], "year").select("iy", "ix", "year", F.round("agb", 5).alias("agb"))


_F1 = _fill_sql(_SPARSE, "iy, ix", "year")
_F2 = _fill_sql(f"select * from f1", "year, iy", "ix")
_F3 = _fill_sql(f"select * from f2", "year, ix", "iy")


@query("f7_fill_gaps", f"with f0 as materialized ({_SPARSE}), f1 as materialized ({_F1}), f2 as materialized ({_F2}), f3 as materialized ({_F3}) select iy, ix, year, round(case when agb is not null then least(greatest(agb, (select min(agb) from f0)), (select max(agb) from f0)) end, 4) agb from f3")
def f7(spark, d):
    return timeseries.fill_gaps(_sparse(spark, d), "agb").select("iy", "ix", "year", F.round("agb", 4).alias("agb"))


@query("f8_forward_fill", f"select iy, ix, year, last_value(igbp ignore nulls) over (partition by iy, ix order by year rows unbounded preceding) igbp from (select g.iy, g.ix, y.year, l.igbp from (select distinct iy, ix from ({A.sql_landcover(40)}) where year < 1999) g cross join (select unnest(range(1995, 2005)) as year) y left join (select * from ({A.sql_landcover(40)}) where year < 1999) l on l.iy = g.iy and l.ix = g.ix and l.year = y.year)")
def f8(spark, d):
    lc = A.landcover(spark, d, 40).where("year < 1999")
    return joins.forward_fill_years(lc, ["iy", "ix"], "igbp", 1995, 2004).select("iy", "ix", "year", "igbp")


@query("d24_disturbed_growth", f"with s as (select iy, ix, arg_max(agb, year) l, arg_min(agb, year) f from ({_PY}) group by iy, ix) select round(avg((l - f) / 6), 6) growth, count(*) n from s where l >= f")
def d24(spark, d):
    s = A.pixel_year(spark, d).groupBy("iy", "ix").agg(F.max_by("agb", "year").alias("l"), F.min_by("agb", "year").alias("f"))
    return s.where("l >= f").agg(F.round(F.avg((F.col("l") - F.col("f")) / 6), 6).alias("growth"), F.count(F.lit(1)).alias("n"))


@query("d25_model_classes", f"select count(*) filter (breakpoint is not null) broken, count(*) filter (breakpoint is null and pvalue <= 0.05) linear, count(*) filter (breakpoint is null and pvalue > 0.05) none from ({_change_sql()})")
def d25(spark, d):
    df = n4(spark, d)
    b, p = F.col("breakpoint").isNotNull(), F.col("pvalue") <= 0.05
    return df.agg(F.count_if(b).alias("broken"), F.count_if(~b & p).alias("linear"), F.count_if(~b & ~p).alias("none"))


@query("d14_spread", f"select iy, ix, min(agb) vmin, max(agb) vmax, round(stddev_pop(agb), 6) sd, count(agb) n from ({_PY}) group by iy, ix")
def d14(spark, d):
    return A.pixel_year(spark, d).groupBy("iy", "ix").agg(F.min("agb").alias("vmin"), F.max("agb").alias("vmax"), F.round(F.stddev_pop("agb"), 6).alias("sd"), F.count("agb").alias("n"))


# ---------------------------------------------------------------- scenes


_SCENE = """select cast(l_partkey % 20 as int) ix, cast(l_suppkey % 20 as int) iy, 'S' || (l_orderkey % 5) scene_id, cast(max(l_linenumber % 4) as int) cloud_qa, case when (l_orderkey % 5) < 2 then 'N' else 'P' end utm_letter,
 cast(floor(max(l_extendedprice)) as bigint) % 20000 "SR_B1", cast(floor(max(l_quantity)) as bigint) * 400 "SR_B2", (cast(floor(max(l_quantity)) as bigint) * 731) % 20000 "SR_B3", (cast(floor(min(l_quantity)) as bigint) * 911) % 30000 "SR_B4", (cast(floor(max(l_discount * 100 + 0.5)) as bigint) * 1500) "SR_B5", (cast(floor(max(l_tax * 100 + 0.5)) as bigint) * 1700) "SR_B7"
 from lineitem group by 1, 2, 3, 5"""


def _scene(spark, d):
    return spark.sql(_SCENE.replace('"', "`").replace("from lineitem", "from {lineitem}"), lineitem=A.read(spark, d, "lineitem"))


_BANDS = landsat.BANDS
_REFL = f"select ix, iy, scene_id, {', '.join(f'case when cloud_qa < 2 and {b} <> 0 then {b} * 0.0000275::double - 0.2::double end {b}' for b in _BANDS)} from ({_SCENE})"


@query("j3_reflectance", f"select ix, iy, scene_id, {', '.join(f'round({b}, 7) {b}' for b in _BANDS)} from ({_REFL})")
def j3(spark, d):
    return landsat.reflectance(_scene(spark, d)).select("ix", "iy", "scene_id", *[F.round(b, 7).alias(b) for b in _BANDS])


_IDX = f"select *, (SR_B4 - SR_B3) / nullif(SR_B4 + SR_B3, 0) NDVI, (SR_B4 - SR_B5) / nullif(SR_B4 + SR_B5, 0) NDII from ({_REFL})"


@query("j4_indices", f"select ix, iy, scene_id, round(NDVI, 5) NDVI, round(NDII, 5) NDII, round(SR_B4 * NDVI, 5) NIR_V from ({_IDX})")
def j4(spark, d):
    return landsat.with_indices(landsat.reflectance(_scene(spark, d))).select("ix", "iy", "scene_id", *[F.round(c, 5).alias(c) for c in ("NDVI", "NDII", "NIR_V")])


@query("d8_scene_composite", f"select ix, iy, {', '.join(f'round(sum(coalesce({b}, 0)) / nullif(count(SR_B1), 0), 5) {b}' for b in (*_BANDS, 'NDVI', 'NDII'))} from ({_IDX}) group by ix, iy")
def d8(spark, d):
    return landsat.seasonal_average(_scene(spark, d)).select("ix", "iy", *[F.round(b, 5).alias(b) for b in (*_BANDS, "NDVI", "NDII")])


@query("j5_common_projection", f"with c as (select iy, utm_letter, count(distinct scene_id) n from ({_SCENE}) group by all), b as (select iy, arg_max(utm_letter, n * 1000 + ascii(utm_letter)) utm_letter from c group by iy) select iy, utm_letter, count(*) n from ({_SCENE}) semi join b using (iy, utm_letter) group by all")
def j5(spark, d):
    return landsat.common_projection(_scene(spark, d), ("iy",)).groupBy("iy", "utm_letter").agg(F.count(F.lit(1)).alias("n"))


_NAMES = "select o_orderkey, cast(o_custkey % 120 as int) row, cast(year(o_orderdate) as int) as year, 'LE07_L2SP_' || lpad(cast(o_custkey % 1000 as varchar), 6, '0') || '_' || strftime(o_orderdate + interval 1 year, '%Y%m%d') || '_20200101_02_T' || (1 + o_orderkey % 2) name from orders"


@query("b14_scene_filter", f"select o_orderkey from (select *, case when row <= 40 then [6, 7, 8] when row >= 80 then [12, 1, 2] else range(1, 13) end m, cast(split_part(name, '_', 4)[1:6] as int) stamp from ({_NAMES})) where name like '%\\_T1%' escape '\\' and list_contains(list_transform(m, lambda x: (case when x < 3 then year + 1 else year end) * 100 + x), stamp)")
def b14(spark, d):
    o = A.read(spark, d, "orders")
    name = F.concat(F.lit("LE07_L2SP_"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 6, "0"), F.lit("_"), F.date_format(F.add_months("o_orderdate", 12), "yyyyMMdd"), F.lit("_20200101_02_T"), (1 + F.col("o_orderkey") % 2).cast("string"))
    stamps = landsat.date_stamps(landsat.months_of_interest((F.col("o_custkey") % 120).cast("int")), F.year("o_orderdate"))
    return o.where(landsat.usable_scene(name, stamps)).select("o_orderkey")


@query("j2_date_stamps", "select o_orderkey, list_sort(list_transform(case when o_custkey % 120 <= 40 then [6, 7, 8] when o_custkey % 120 >= 80 then [12, 1, 2] else range(1, 13) end, lambda x: cast((case when x < 3 then year(o_orderdate) + 1 else year(o_orderdate) end) * 100 + x as int))) stamps from orders")
def j2(spark, d):
    o = A.read(spark, d, "orders")
    return o.select("o_orderkey", F.array_sort(landsat.date_stamps(landsat.months_of_interest((F.col("o_custkey") % 120).cast("int")), F.year("o_orderdate"))).alias("stamps"))


@query("f11_season_year", "select o_orderkey, cast(case when month(o_orderdate) < 3 then year(o_orderdate) - 1 else year(o_orderdate) end as int) season from orders")
def f11(spark, d):
    return A.read(spark, d, "orders").select("o_orderkey", landsat.season_year(F.month("o_orderdate"), F.year("o_orderdate")).alias("season"))


# ---------------------------------------------------------------- boxes, joins and keys


@query("b1_half_open_box", f"select x, y, biomass from ({A.SQL_POINTS}) where y > 2 and y <= 5 and x > 1 and x <= 4")
def b1(spark, d):
    return filters.half_open_box(A.points(spark, d), 2, 5, 1, 4, "y", "x").select("x", "y", "biomass")


@query("b3_closed_box", f"select x, y, biomass from ({A.SQL_POINTS}) where y between 2 and 5 and x between 1 and 4")
def b3(spark, d):
    return filters.closed_box(A.points(spark, d), 2, 5, 1, 4, "y", "x").select("x", "y", "biomass")


@query("b10_where_other", f"select ix, iy, year, case when agb > 25 then agb else 0.0::double end agb from ({_PY})")
def b10(spark, d):
    return filters.keep_where(A.pixel_year(spark, d), F.col("agb") > 25, ["agb"], F.lit(0.0)).select("ix", "iy", "year", "agb")


@query("b9_complete_rows", f"select ix, iy, scene_id from ({_REFL}) where {' and '.join(f'{b} is not null' for b in _BANDS)}")
def b9(spark, d):
    return filters.complete_rows(landsat.reflectance(_scene(spark, d)), list(_BANDS)).select("ix", "iy", "scene_id")


@query("b16_optional_filters", "select count(*) n from orders where o_orderstatus = 'F' and o_totalprice between 1000 and 90000")
def b16(spark, d):
    return filters.where_given(A.read(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None, o_totalprice=(1000, 90000)).agg(F.count(F.lit(1)).alias("n"))


@query("c1_nearest_lookup", f"select x, y, o.year, l.igbp from ({A.SQL_POINTS}) o left join ({A.sql_landcover()}) l on l.iy = cast(least(greatest(floor((10.0::double - 0.125 - y) / 0.25 + 0.5), 0), 19) as int) and l.ix = cast(least(greatest(floor((x - 0.125) / 0.25 + 0.5), 0), 19) as int) and l.year = least(greatest(o.year, 1995), 2001)")
def c1(spark, d):
    """Latitude descends, so its step is negative; coordinates beyond the grid take the edge."""
    pts = A.points(spark, d).withColumns({"lat": F.lit(9.875) - F.col("y"), "lon": F.col("x")})
    return joins.nearest_lookup(pts, A.landcover(spark, d), "igbp", 0.0, 0.25, 20, 0.125, 0.25, 20, (1995, 2001)).select("x", "y", "year", "igbp")


@query("c2_nearest_tolerance", f"select x, y, case when abs(10.0::double - 0.125 - 0.25 * iy - y) <= 1 and abs(0.125 + 0.25 * ix - x) <= 1 then iy * 20 + ix end cell from (select *, least(greatest(floor((9.875::double - y) / 0.25 + 0.5), 0), 19) iy, least(greatest(floor((x - 0.125) / 0.25 + 0.5), 0), 19) ix from ({A.SQL_POINTS}))")
def c2(spark, d):
    p = A.points(spark, d)
    keys = p.withColumns({"iy": grid.nearest_key(F.lit(9.875) - F.col("y"), 0.0, 0.25, 20), "ix": grid.nearest_key(F.col("x"), 0.125, 0.25, 20)})
    cell = joins.within((F.col("iy") * 20 + F.col("ix")).cast("double"), F.col("y"), F.col("x"), F.lit(9.875) - 0.25 * F.col("iy"), 0.125 + 0.25 * F.col("ix"), 1.0)
    return keys.select("x", "y", cell.alias("cell"))


@query("c8_rounded_join", f"with a as (select round_even(x + 0.011::double, 1) k, round_even(y + 0.011::double, 1) l, biomass b, year from ({A.SQL_POINTS}) where year = 1996), c as (select round_even(x + 0.011::double, 1) k, round_even(y + 0.011::double, 1) l, biomass b, year from ({A.SQL_POINTS}) where year = 1997) select count(*) n, round(sum(a.b - c.b), 3) difference from a join c using (k, l)")
def c8(spark, d):
    p = A.points(spark, d).withColumns({"x": F.col("x") + 0.011, "y": F.col("y") + 0.011})  # off the ties
    out = joins.rounded_join(p.where("year = 1996"), p.where("year = 1997"), 1, lat="y", lon="x")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("biomass") - F.col("biomass_b")), 3).alias("difference"))


@query("c10_reindex", f"select cast(i // 25 as int) iy, cast(i % 25 as int) ix, agb from range(625) t(i) left join (select iy, ix, agb from ({_PY}) where year = 1998) p on p.iy = i // 25 and p.ix = i % 25")
def c10(spark, d):
    return joins.reindex(A.pixel_year(spark, d).where("year = 1998").drop("year"), 25, 25).select("iy", "ix", "agb")


@query("c13_year_pairs", f"select a.iy, a.ix, round(b.agb - a.agb, 6) difference from ({_PY}) a join ({_PY}) b using (iy, ix) where a.year = 1996 and b.year = 2000")
def c13(spark, d):
    p = A.pixel_year(spark, d)
    a, b = p.where("year = 1996").drop("year"), p.where("year = 2000").select("iy", "ix", F.col("agb").alias("later"))
    return a.join(b, ["iy", "ix"]).select("iy", "ix", F.round(F.col("later") - F.col("agb"), 6).alias("difference"))


@query("c14_tiles_over_boxes", "select t.a tile, b.a box from (select r_regionkey a, r_regionkey * 10 x0, r_regionkey * 10 + 10 x1 from region) t join (select n_nationkey a, n_nationkey * 2 x0, n_nationkey * 2 + 5 x1 from nation) b on t.x0 <= b.x1 and b.x0 <= t.x1")
def c14(spark, d):
    box = lambda df, k, w, s: df.select(F.col(k).alias("a"), (F.col(k) * s).alias("min_x"), (F.col(k) * s + w).alias("max_x"), F.lit(0).alias("min_y"), F.lit(1).alias("max_y"))
    out = joins.tiles_over_boxes(box(A.read(spark, d, "region"), "r_regionkey", 10, 10), box(A.read(spark, d, "nation"), "n_nationkey", 5, 2))
    return out.select(F.col("a").alias("tile"), F.col("b_a").alias("box"))


@query("c15_pending_tasks", "select n_nationkey from nation where n_nationkey not in (select n_nationkey from nation where n_nationkey % 3 = 0)")
def c15(spark, d):
    n = A.read(spark, d, "nation").select("n_nationkey")
    return n.join(n.where("n_nationkey % 3 = 0"), "n_nationkey", "left_anti")


@query("c3_inner_alignment", f"select count(*) n, round(sum(agb), 3) agb from ({_PY}) join ({A.sql_burned()}) using (iy, ix, year)")
def c3(spark, d):
    return A.pixel_year(spark, d).join(A.burned(spark, d), ["iy", "ix", "year"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("agb"), 3).alias("agb"))


@query("b15_record_semi_join", "select count(*) n from orders semi join (select distinct l_orderkey o_orderkey from lineitem where l_returnflag = 'R') using (o_orderkey)")
def b15(spark, d):
    r = A.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.read(spark, d, "orders").join(r, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("c7_strict_lookup", "select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey")
def c7(spark, d):
    r = A.read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.strict_lookup(A.read(spark, d, "nation"), r, "n_regionkey", "r_name").select("n_nationkey", "r_name")


# ---------------------------------------------------------------- aggregates


@query("d7_grid_points", f"select cast(floor(round((10 - round(y, 6)) / 0.25, 6)) as int) iy, cast(floor(round(round(x, 6) / 0.25, 6)) as int) ix, year, round(avg(biomass), 6) biomass from ({A.SQL_POINTS}) where floor(round((10 - round(y, 6)) / 0.25, 6)) between 0 and 29 and floor(round(round(x, 6) / 0.25, 6)) between 0 and 35 group by 1, 2, 3")
def d7(spark, d):
    return aggregate.grid_points(A.points(spark, d), "x", "y", "biomass", 0.0, 10.0, 0.25, 30, 36, ("year",)).withColumn("biomass", F.round("biomass", 6))


@query("d9_month_weighted_mean", "select c_nationkey, round(sum(o_totalprice * w) / nullif(sum(w), 0), 4) o_totalprice from (select c_nationkey, o_totalprice, [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month(o_orderdate)]::double w from orders join customer on o_custkey = c_custkey) group by 1")
def d9(spark, d):
    o = A.read(spark, d, "orders").join(A.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("month", F.month("o_orderdate"))
    return aggregate.month_weighted_mean(o, ["c_nationkey"], "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("d10_any_all", f"select ix, iy, bool_or(igbp > 0) any_land, bool_and(igbp > 0) all_land from ({A.sql_landcover(40)}) group by ix, iy")
def d10(spark, d):
    return A.landcover(spark, d, 40).groupBy("ix", "iy").agg(F.bool_or(F.col("igbp") > 0).alias("any_land"), F.bool_and(F.col("igbp") > 0).alias("all_land"))


@query("d12_mode", "select p_brand, arg_max(p_type, (n, p_type)) p_type, sum(n)::bigint n from (select p_brand, p_type, count(*) n from part group by all) group by 1")
def d12(spark, d):
    """The most frequent type; of equals the last in the alphabet."""
    c = A.read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_brand").agg(F.max(F.struct("n", "p_type"))["p_type"].alias("p_type"), F.sum("n").alias("n"))


@query("d18_percentiles", "select o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 6) p95, round(quantile_cont(o_totalprice, 0.995), 6) p995 from orders group by 1")
def d18(spark, d):
    found = ranks.percentiles(A.read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"p95": 0.95, "p995": 0.995})
    return found.select("o_orderpriority", F.round("p95", 6).alias("p95"), F.round("p995", 6).alias("p995"))


@query("d18_percentiles_with_ties", "select event_type, quantile_cont(value, 0.0) least, round(quantile_cont(value, 0.25), 6) q1, round(quantile_cont(value, 0.5), 6) median, quantile_cont(value, 1.0) most from (select event_type, case when event_id % 3 > 0 then round(value) * (event_id % 2 * 2 - 1) end as value from events) where value is not null group by 1")
def d18_ties(spark, d):
    """Few distinct values on both sides of zero, and missing ones."""
    e = A.read(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 > 0, F.round("value") * (F.col("event_id") % 2 * 2 - 1)).alias("value"))
    found = ranks.percentiles(e, ["event_type"], "value", {"least": 0.0, "q1": 0.25, "median": 0.5, "most": 1.0})
    return found.select("event_type", "least", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"), "most")


@query("a13_batches", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast((row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 100 as int) batch from lineitem")
def a13b(spark, d):
    """Line items in batches of a hundred, in order of their keys."""
    li = A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return catalog.batches(li, "l_orderkey", 100, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("d19_histogram", f"select cast(least(floor(biomass / (600.0::double / 80)), 79) as int) bin, count(*) n from ({A.SQL_POINTS}) where biomass between 0 and 600 group by 1")
def d19(spark, d):
    return aggregate.histogram(A.points(spark, d), "biomass", 0.0, 600.0, 80)


@query("d19_histogram_2d", f"select cast(least(floor(x / 0.1), 99) as int) bin_x, cast(least(floor(y / 0.1), 99) as int) bin_y, count(*) n from ({A.SQL_POINTS}) where x between 0 and 10 and y between 0 and 10 group by 1, 2")
def d19b(spark, d):
    return aggregate.histogram_2d(A.points(spark, d), "x", "y", 0.0, 10.0, 100)


@query("d20_right_closed_bins", f"select cast(ceil(round(x / 0.1, 6)) - 1 as int) bin, round(avg(biomass), 5) biomass from ({A.SQL_POINTS}) group by 1")
def d20(spark, d):
    return A.points(spark, d).groupBy(aggregate.cut_right_closed(F.col("x"), 0.0, 0.1).alias("bin")).agg(F.round(F.avg("biomass"), 5).alias("biomass"))


_PAIRS = "select c_mktsegment segment, o_orderpriority priority, cast(o_custkey % 30 as int) shots, floor(o_totalprice) y, floor(o_totalprice) * 0.9::double + c_acctbal p from orders join customer on o_custkey = c_custkey"


def _pairs(spark, d):
    o = A.read(spark, d, "orders").join(A.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = F.floor("o_totalprice").cast("double")
    return o.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 30).cast("int").alias("shots"), y.alias("y"), (y * 0.9 + F.col("c_acctbal")).alias("p"))


@query("d21_error_metrics", f"select segment, round(avg(p - y), 3) bias, round(avg(abs(p - y)), 3) mae, round(sqrt(avg((p - y) * (p - y))), 3) rmse, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 5) r2, count(*) n from ({_PAIRS}) group by 1")
def d21(spark, d):
    out = aggregate.error_metrics(_pairs(spark, d), ["segment"], "y", "p")
    return out.select("segment", *[F.round(c, 3).alias(c) for c in ("bias", "mae", "rmse")], F.round("r2", 5).alias("r2"), "n")


@query("d22_threshold_sweep", f"select threshold, segment, priority, round(avg(p - y), 2) bias, round(avg(abs(p - y)), 2) mae, count(*) n from ({_PAIRS}), (select unnest([0, 10, 20]) threshold) where shots >= threshold group by grouping sets ((threshold), (threshold, segment), (threshold, segment, priority))")
def d22(spark, d):
    out = aggregate.threshold_sweep(_pairs(spark, d), "shots", [0, 10, 20], "y", "p", ["segment", "priority"])
    return out.select("threshold", "segment", "priority", F.round("bias", 2).alias("bias"), F.round("mae", 2).alias("mae"), "n")


@query("d23_weighted_scores", "select round(sum(avg_price * n) / sum(n), 4) score from (select o_orderpriority, avg(o_totalprice) avg_price, count(*) n from orders group by 1)")
def d23(spark, d):
    g = A.read(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(safe_div(F.sum(F.col("v") * F.col("n")), F.sum("n")), 4).alias("score"))


@query("d28_regrid_sum", f"select cast(floor((iy + 0.5) / 3.5) as int) iy, cast(floor((ix + 0.5) / 3.5) as int) ix, round(sum(agb), 5) agb from ({_PY}) where year = 1999 group by 1, 2")
def d28(spark, d):
    key = lambda c: F.floor((F.col(c) + 0.5) / 3.5).cast("int").alias(c)
    return A.pixel_year(spark, d).where("year = 1999").groupBy(key("iy"), key("ix")).agg(F.round(F.sum("agb"), 5).alias("agb"))


# ---------------------------------------------------------------- order, sets and tiles


@query("k2_top_errors", f"select segment, priority, round(avg(abs(p - y)), 3) mae from ({_PAIRS}) group by 1, 2 order by 3 desc, 1, 2 limit 20")
def k2(spark, d):
    g = _pairs(spark, d).groupBy("segment", "priority").agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 3).alias("mae"))
    return g.orderBy(F.desc("mae"), "segment", "priority").limit(20)


@query("k4_union", f"select ix, iy, agb, null::int igbp from ({_PY}) union all select ix, iy, null, igbp from ({A.sql_landcover()})")
def k4(spark, d):
    return setops.union_all([A.pixel_year(spark, d).drop("year"), A.landcover(spark, d).drop("year")]).select("ix", "iy", "agb", "igbp")


@query("k5_mosaic", f"select iy, ix, coalesce(max(agb) filter (year = 1996), max(agb) filter (year = 1997)) agb from ({A.sql_pixel_year(80)}) where year in (1996, 1997) group by iy, ix")
def k5(spark, d):
    p = A.pixel_year(spark, d, 80)
    return setops.mosaic([p.where("year = 1996"), p.where("year = 1997")], ["iy", "ix"], ["agb"])


@query("k7_set_difference", "select distinct l_partkey % 100 k from lineitem where l_returnflag = 'R' except select distinct l_partkey % 100 from lineitem where l_discount = 0.05 and l_quantity < 2")
def k7(spark, d):
    li = A.read(spark, d, "lineitem")
    key = (F.col("l_partkey") % 100).alias("k")
    return li.where("l_returnflag = 'R'").select(key).distinct().subtract(li.where("l_discount = 0.05 and l_quantity < 2").select(key))


@query("k8_sample_per_class", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by md5(p_partkey::varchar), p_partkey) n from part) where n <= 5")
def k8(spark, d):
    return filters.sample_per_class(A.read(spark, d, "part"), "p_brand", "p_partkey", 5).select("p_brand", "p_partkey")


@query("b18_sample")
def b18(spark, d):
    """Fifty rows by the hash of their keys; the sample is the feature."""
    return filters.sample_rows(A.read(spark, d, "orders"), "o_orderkey", 50)


@query("t3_tile_tags", "select i lat, i * 2 lon, lpad(abs(ceil(i + 0.5))::int::varchar, 2, '0') || case when ceil(i + 0.5) < 0 then 'S' else 'N' end lat_tag, lpad(abs(i * 2)::int::varchar, 3, '0') || case when i * 2 < 0 then 'W' else 'E' end lon_tag from (select n_nationkey - 12 i from nation)")
def t3(spark, d):
    n = A.read(spark, d, "nation").select((F.col("n_nationkey") - 12).alias("lat"))
    a, b = grid.tags_from_box(F.col("lat") + 0.5, F.col("lat") * 2)
    return n.select("lat", (F.col("lat") * 2).alias("lon"), a.alias("lat_tag"), b.alias("lon_tag"))


@query("t2_tile_boxes", "select lat || 'N_' || lon || 'W' tile, (lat - 10)::int min_lat, lat::int max_lat, (-lon)::int min_lon, (10 - lon)::int max_lon from (select 20 + 10 * (n_nationkey % 5) lat, 100 + 10 * n_nationkey::int // 5 lon from nation)")
def t2(spark, d):
    n = A.read(spark, d, "nation").select((20 + 10 * (F.col("n_nationkey") % 5)).alias("lat"), F.expr("100 + 10 * n_nationkey div 5").alias("lon"))
    tile = n.select(F.concat(F.col("lat").cast("string"), F.lit("N_"), F.col("lon").cast("string"), F.lit("W")).alias("tile"))
    a, b = grid.tags_from_path(F.concat(F.lit("s3://bucket/x/"), F.col("tile"), F.lit(".tif")))
    box = grid.box_from_tags(a, b)
    return tile.select("tile", *[c.alias(k) for k, c in zip(("min_lat", "max_lat", "min_lon", "max_lon"), box)])


@query("t4_tiles_for_box", "select lat::int lat, lon::int lon from (select unnest([10, 20]) lat), (select unnest([-20, -10, 0]) lon)")
def t4(spark, d):
    return setops.tiles_for_box(spark, 5.0, 15.0, -15.0, 5.0)


@query("t5_wrap_longitude", "select event_id, ((event_id * 7 % 720 - 180 + 180.0::double) % 360 + 360) % 360 - 180 lon from events")
def t5(spark, d):
    return A.read(spark, d, "events").select("event_id", grid.wrap_longitude((F.col("event_id") * 7 % 720 - 180).cast("double")).alias("lon"))


@query("t9_year_doy", "select event_id, (2000 + event_id % 20)::int as year, (1 + event_id % 365)::int doy from events")
def t9(spark, d):
    e = A.read(spark, d, "events")
    tag = F.concat(F.lit("A"), (2000 + F.col("event_id") % 20).cast("string"), F.lpad((1 + F.col("event_id") % 365).cast("string"), 3, "0"))
    year, doy = grid.year_doy(tag)
    return e.select("event_id", year.alias("year"), doy.alias("doy"))


@query("j7_utm_band", "select event_id, case when lat between -80 and 84 then substr('CDEFGHJKLMNPQRSTUVWX', least(floor((lat + 80) / 8), 19)::int + 1, 1) end band from (select event_id, event_id % 181 - 90 lat from events)")
def j7(spark, d):
    return A.read(spark, d, "events").select("event_id", grid.utm_band(F.col("event_id") % 181 - 90).alias("band"))


@query("a11_shot_ids", "select lpad(l_orderkey::varchar, 9, '0') || '_' || lpad(l_linenumber::varchar, 2, '0') shot_id, count(*) n from lineitem group by 1")
def a11(spark, d):
    return A.read(spark, d, "lineitem").groupBy(catalog.shot_ids(F.col("l_orderkey"), F.col("l_linenumber")).alias("shot_id")).agg(F.count(F.lit(1)).alias("n"))


@query("a13_download_links", "select min(o_orderkey) as position, 'http://x/' || (min(o_orderkey) % 7) || '/f' || (o_orderkey % 500) || '.h5' href, 'f' || (o_orderkey % 500) || '.h5' basename from orders where o_orderkey % 11 > 0 and o_custkey % 3 = 0 group by o_orderkey % 500")
def a13(spark, d):
    o = A.read(spark, d, "orders")
    links = o.select(F.col("o_orderkey").alias("position"), F.concat(F.lit("http://x/"), (F.col("o_orderkey") % 7).cast("string"), F.lit("/f"), (F.col("o_orderkey") % 500).cast("string"), F.lit(".h5")).alias("href"), (F.col("o_orderkey") % 11 == 0).alias("inherited"), F.when(F.col("o_custkey") % 3 == 0, "http://esipfed.org/ns/fedsearch/1.1/data#").otherwise("meta").alias("rel"), F.lit("granule").alias("title"))
    return catalog.first_by_basename(links)


@query("a9_sample_locations", "select vec_id, case when vec_id % 128 <> 127 then embedding[vec_id % 128] end location from embeddings")
def a9(spark, d):
    """A table of 64 locations, indexed from 1; 127 names none, as does an index beyond the table."""
    e = A.read(spark, d, "embeddings")
    return e.select("vec_id", catalog.sample_locations(F.col("embedding"), F.col("vec_id") % 128).alias("location"))


@query("l5_baseline", f"select round((select avg(y) from ({_PAIRS}) where shots < 20), 4) prediction, count(*) n from ({_PAIRS}) where shots >= 20")
def l5(spark, d):
    from ..ml import models

    p = _pairs(spark, d)
    out = models.baseline(p.where("shots < 20"), p.where("shots >= 20"), "y")
    return out.groupBy(F.round("prediction", 4).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query("l2_year_split", f"select case when year = 2001 then 'validation' when year = 2000 then 'test' else 'train' end part, count(*) n from ({_PY}) group by 1")
def l2(spark, d):
    from ..ml import models

    parts = models.split_by_year(A.pixel_year(spark, d), 1995, 2001, "last")
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "test", "validation"))]
    return setops.union_all(named).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("l7_random_forest")
def l7(spark, d):
    """A small forest on part attributes; pyspark.ml's trees have no counterpart in SQL."""
    from ..ml import models

    li = A.read(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("biomass"), F.avg("l_quantity").alias("quantity"))
    rows = li.join(A.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", "biomass", "quantity", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    features = ["quantity", "size", "p_retailprice"]
    model = models.random_forest(rows.where("l_partkey % 5 > 0"), features, trees=10, depth=5)
    return models.evaluate(model.transform(rows.where("l_partkey % 5 = 0")))
