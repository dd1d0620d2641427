"""Hand-computed cases, closed forms and properties."""

import math

import pytest
from pyspark.sql import functions as F

from forestflux.functions import geometry, grid, nulls, stats
from forestflux.functions import waveform as W
from forestflux.operators import aggregate, allometry, emissions, filters, joins, lidar, setops, timeseries
from forestflux.sources import catalog, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_null_rules(spark):
    r = one(spark, nulls.safe_div(F.lit(1.0), F.lit(0.0)), nulls.clip(F.lit(None).cast("double"), 0.0), nulls.clip(F.lit(-2.0), 0.0), nulls.member(F.lit(None).cast("int"), (1, 2)), nulls.nan_to_null(F.lit(float("nan"))))
    assert tuple(r) == (None, None, 0.0, False, None)


@pytest.mark.parametrize(("f", "cdf"), [(stats.f_cdf_3_3, lambda f: _numeric(f, 3, 3)), (stats.f_cdf_1_5, lambda f: _numeric(f, 1, 5))])
def test_f_distributions(spark, f, cdf):
    for x in (0.5, 1.0, 4.0, 11.81):
        assert one(spark, f(F.lit(x)))[0] == pytest.approx(cdf(x), abs=2e-4)


def _numeric(f, a, b, n=200_000):
    beta = math.gamma(a / 2) * math.gamma(b / 2) / math.gamma((a + b) / 2)
    total = 0.0
    for i in range(n):  # substitution x = f u^2 removes the pole at 0
        u = (i + 0.5) / n
        x = f * u * u
        total += (a / b) ** (a / 2) * x ** (a / 2 - 1) * (1 + a * x / b) ** (-(a + b) / 2) / beta * 2 * f * u / n
    return total


def test_tags_round_trip(spark):
    corners = [(lat, lon) for lat in range(-50, 81, 10) for lon in range(-180, 171, 10)]
    df = spark.createDataFrame(corners, "lat int, lon int")
    a, b = grid.tile_tag(F.col("lat"), F.col("lon"))
    df = df.select("lat", "lon", F.concat_ws("_", a, b).alias("tile"))
    c, d = grid.tags_from_path(F.concat(F.lit("x/"), "tile", F.lit(".tif")))
    _, north, west, _ = grid.box_from_tags(c, d)
    assert df.where((north != F.col("lat")) | (west != F.col("lon"))).count() == 0


def test_polygon_edges(spark):
    ring = geometry.box_ring(F.lit(0), F.lit(0), F.lit(2), F.lit(2))
    r = one(spark, *[geometry.in_ring(F.lit(x), F.lit(y), ring) for x, y in ((1.0, 1.0), (0.0, 0.0), (2.0, 1.0), (1.0, 2.0), (3.0, 1.0))])
    assert tuple(r) == (True, True, False, False, False)


def test_overlapping_polygons_take_the_least_id(spark):
    cells = spark.createDataFrame([(0, 0, 0.5, 0.5), (0, 1, 5.0, 5.0)], "iy int, ix int, lat double, lon double")
    ring = geometry.box_ring(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    shapes = spark.range(2, 4).select(F.col("id").cast("int").alias("id"), ring.alias("ring"))
    assert {(r.ix, r.region) for r in joins.polygon_mask(cells, shapes).collect()} == {(0, 2), (1, None)}


def test_no_cross_products(spark):
    cells = spark.range(10).select(F.lit(0).alias("iy"), F.col("id").cast("int").alias("ix"), F.lit(0.5).alias("lat"), (F.col("id") + 0.5).alias("lon"))
    ring = geometry.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(1))
    shapes = spark.range(1).select(F.col("id").cast("int").alias("id"), ring.alias("ring"))
    plan = joins.polygon_mask(cells, shapes)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_fill_axis_single_point_and_edges(spark):
    rows = [(1, 0, None), (1, 1, 4.0), (1, 2, None), (2, 0, None), (2, 1, 1.0), (2, 2, 2.0), (2, 3, None), (3, 0, None)]
    df = timeseries.fill_axis(spark.createDataFrame(rows, "k int, t int, v double"), "v", ["k"], "t")
    assert [(r.k, r.t, r.v) for r in df.orderBy("k", "t").collect()] == [(1, 0, 4.0), (1, 1, 4.0), (1, 2, 4.0), (2, 0, 0.0), (2, 1, 1.0), (2, 2, 2.0), (2, 3, 3.0), (3, 0, None)]


def test_change_point_cases(spark):
    series = {0: [1.0, 2.0, 3.1, 4.0, 5.0, 6.0, 7.0], 1: [10.0, 10.1, 10.0, 10.1, 2.0, 2.1, 2.0], 2: [5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0]}
    rows = [(k, 0, 2014 + i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    rows += [(9, 0, 2014, 1.0)]  # a short series has no result
    out = {r.iy: r for r in timeseries.change_points(spark.createDataFrame(rows, "iy int, ix int, year int, agb double"), strict=False).collect()}
    assert set(out) == {0, 1, 2}
    assert out[0].breakpoint is None and out[0].pvalue < 0.05
    assert out[1].breakpoint == 4 and out[1].prediction[4] == pytest.approx(2.03, abs=0.1)
    assert out[2].breakpoint is None and out[2].prediction == [5.0] * 7  # no residuals: no F, so the mean


def test_fire_plus_clearing_is_total(spark):
    df = spark.createDataFrame([(0, 0, 2010, 5.0, 1), (0, 0, 2011, 7.0, None), (0, 0, 2012, 2.0, None)], "iy int, ix int, year int, emissions double, burned int")
    out = emissions.split_by_fire(timeseries.attribute_to_fire(df)).orderBy("year").collect()
    assert [(r.emissions_fire, r.emissions_clearing) for r in out] == [(5.0, 0.0), (7.0, 0.0), (0.0, 2.0)]


def test_coarsen_sum_keeps_totals(spark):
    df = spark.range(100).select((F.col("id") / 10).cast("int").alias("iy"), (F.col("id") % 10).cast("int").alias("ix"), F.lit(2000).alias("year"), F.col("id").cast("double").alias("v"), F.lit(2.0).alias("a"))
    assert aggregate.coarsen_sum(df, "v", "a", 5).agg(F.sum("v")).first()[0] == 2 * 4950.0


def test_ecoregion_conflict(spark):
    r = one(spark.range(1).select(F.lit(622).alias("ecoregion")).sparkSession, F.lit(1))
    assert r
    df = spark.createDataFrame([(622,), (0,), (129,), (999,), (None,)], "ecoregion int")
    got = [tuple(x) for x in df.select(F.expr(allometry.group_sql()), allometry.realm()).collect()]
    assert got == [("tropical_neotropic", "tropical_asia"), ("", "ice"), ("", "ice"), ("", "nan"), ("", "nan")]


def test_every_group_id_is_listed_once_but_one():
    seen: dict[int, list] = {}
    for g, r in allometry.ECOREGION_GROUPS.items():
        for i in allometry.ids(r):
            seen.setdefault(i, []).append(g)
    assert {i for i, g in seen.items() if len(g) > 1} == {622}


def test_equation_priorities(spark):
    base = {"nlcd": None, "eosd": None, "igbp": 0, "burned": False, "f_slope": 1.0, "senergy": 30.0}
    cases = [
        ({"ecoregion": 346, "nlcd": 42, "burned": True}, "conus_conifer_hyde_2007"),
        ({"ecoregion": 346, "nlcd": 11, "burned": True}, "zero_biomass"),
        ({"ecoregion": 404, "nlcd": 90, "f_slope": 3.0}, "ak_wetland_steep"),
        ({"ecoregion": 404, "nlcd": 90, "f_slope": None}, "alaska"),
        ({"ecoregion": 370, "eosd": 231}, "e_canada_mixedwood_high"),
        ({"ecoregion": 370, "eosd": 51}, "zero_biomass"),
        ({"ecoregion": 691, "igbp": 1}, "wbe_confier"),
        ({"ecoregion": 324, "igbp": 3}, "mexico_north_conifer"),
        ({"ecoregion": 1}, "afrotropic"),
        ({"ecoregion": 999}, ""),
    ]
    rows = [tuple({**base, **c}[k] for k in ("ecoregion", "nlcd", "eosd", "igbp", "burned", "f_slope", "senergy")) for c, _ in cases]
    df = spark.createDataFrame(rows, "ecoregion int, nlcd int, eosd int, igbp int, burned boolean, f_slope double, senergy double")
    assert [r.allometric_eq for r in allometry.assign_equations(df).collect()] == [w for _, w in cases]


def test_unknown_metric_and_recalculation(spark):
    with pytest.raises(NotImplementedError):
        lidar.add_metrics(spark.range(1), ["no_such_metric"])


def test_ground_of_waveform_fallbacks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.1, 0.5, 0.2, 0.1]), ([1.0, 2.0, 3.0, 4.0], [0.4, 0.3, 0.2, 0.1])], "d array<double>, w array<double>")
    assert [r[0] for r in df.select(W.ground_of_waveform(F.col("d"), F.col("w"))).collect()] == [2.0, 1.0]


def test_volt_table():
    assert W.volt_step(0) == -0.195279 and W.volt_step(1) == -0.188604 and W.volt_step(127) == pytest.approx(0.652446)
    assert W.volt_step(128) == pytest.approx(0.658924) and W.volt_step(255) == pytest.approx(1.44607)


def test_overlap_groups_never_merge():
    assert setops.overlap_groups([{1, 2}, {5, 6}, {2, 5}, {6}]) == [[0, 2], [1, 3]]
    assert setops.overlap_groups([{1, 2}, {5, 6}, {2, 5}]) == [[0, 2], [1]]


def test_strict_lookup_fails_on_unknown_keys(spark):
    df, t = spark.createDataFrame([(1,), (7,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no v for k 7"):
        joins.strict_lookup(df, t, "k", "v").collect()


def test_catalog_sinks_and_manifest(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("A", 1, 1.0), ("B", 2, 2.0)], "tile_id string, subtile int, v double")
    sinks.write_region(df, f"{root}/r")
    sinks.write_region(df.where("tile_id = 'A'").withColumn("v", F.lit(9.0)), f"{root}/r")
    assert {(r.tile_id, r.v) for r in spark.read.parquet(f"{root}/r").collect()} == {("A", 9.0), ("B", 2.0)}
    assert sinks.is_complete(spark, f"{root}/r") and not sinks.is_complete(spark, f"{root}/none")
    tasks = spark.createDataFrame([("A",), ("B",)], "task string")
    sinks.log_tasks(tasks.where("task = 'A'"), f"{root}/log")
    assert [r.task for r in sinks.pending(tasks, sinks.manifest(spark, f"{root}/log")).collect()] == ["B"]
    assert catalog.read_present(spark, [f"{root}/none"], "a int").count() == 0
    rollup = spark.createDataFrame([("BRA", "2001-01-01", "2002-01-01", 1.5)], "iso3_country string, begin_date string, end_date string, tCO2eq double")
    sinks.write_rollup(rollup, f"{root}/v1/rollup")
    assert catalog.load(spark, "country_rollup", root=root).first().tCO2eq == 1.5
    with pytest.raises(KeyError):
        catalog.load(spark, "nothing", root=root)


def test_ingest_sees_files_once(spark, tmp_path):
    from forestflux.streaming.ingest import ingest_new

    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        ingest_new(spark, src, "id long", out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    spark.range(2).write.mode("append").parquet(src)
    ingest_new(spark, src, "id long", out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_seasons_of_special_equations(spark):
    rows = [("2005-07-01", 50.0, "alaska"), ("2005-07-01", 50.0, "conus_conifer_popescu_2011"), ("2005-02-01", 50.0, "conus_conifer_popescu_2011"), ("2009-05-01", 0.0, "alaska"), ("2003-03-25", 0.0, "alaska"), ("2006-11-01", 50.0, "alaska")]
    df = spark.createDataFrame(rows, "t string, lat double, allometric_eq string").withColumn("time", F.to_timestamp("t"))
    assert {(r.t, r.allometric_eq) for r in filters.leaf_on(df).collect()} == {("2005-07-01", "alaska"), ("2005-02-01", "conus_conifer_popescu_2011")}


def test_tails_of_f(spark):
    """Critical values of printed tables at 0.05 and 0.01."""
    from forestflux.functions.stats import f_tail_1

    rows = [(1, 161.4476, 0.05), (2, 18.5128, 0.05), (3, 10.1280, 0.05), (4, 7.7086, 0.05), (5, 6.6079, 0.05), (10, 4.9646, 0.05), (15, 4.5431, 0.05), (5, 16.2582, 0.01), (20, 8.0960, 0.01)]
    got = spark.createDataFrame(rows, "d int, f double, p double").select(f_tail_1(F.col("f"), F.col("d")).alias("g"), "p").collect()
    assert all(abs(r.g - r.p) < 2e-5 for r in got)


def test_p_value_of_a_line(spark):
    """y = 1, 3, 2, 5, 4 over 1..5: r is 0.8, F is 16/3 on (1, 3), p is 0.1041 (two-sided t of 2.3094)."""
    rows = [(0, i, float(y)) for i, y in enumerate((1, 3, 2, 5, 4), 1)] + [(1, i, 2.0 * i) for i in range(4)] + [(2, 1, 7.0)]
    got = {r.k: r for r in timeseries.linear_regression(spark.createDataFrame(rows, "k int, x int, y double"), ["k"], "x", "y").collect()}
    assert got[0].pvalue == pytest.approx(0.1041, abs=1e-4) and got[1].pvalue < 1e-6 and (got[2].pvalue, got[2].slope, got[2].intercept) == (0.0, 0.0, 7.0)


def test_gaps_and_short_series(spark):
    rows = [(0, 0, y, v) for y, v in enumerate((1.0, None, 3.0, None, None, None, 7.0))]
    df = spark.createDataFrame(rows, "iy int, ix int, year int, v double")
    near = [r.v for r in timeseries.fill_axis(df, "v", ["iy", "ix"], "year", max_gap=2).orderBy("year").collect()]
    assert near == [1.0, 2.0, 3.0, None, None, None, 7.0]
    with pytest.raises(Exception, match="seven years"):
        timeseries.change_points(df.where("year < 6"), "v").collect()


def test_training_files(spark, tmp_path):
    """Scenes are written by realm and year; a scene written again replaces itself alone, and end years are exclusive."""
    from forestflux.operators import training

    rows = spark.createDataFrame([(1.0, "nearctic"), (2.0, "neotropic")], "biomass double, realm string")
    folder = str(tmp_path / "t")
    for year, scene in ((2003, "044032"), (2003, "044033"), (2009, "044032"), (2010, "044032"), (2003, "044032")):
        training.write_training(rows, folder, year, scene)
    assert training.training(spark, folder, "nearctic").count() == 3 and training.training(spark, folder, "nearctic", 2003, 2011).count() == 4
    with pytest.raises(FileNotFoundError):
        training.training(spark, folder + "x", "nearctic")


def test_reprojection_to_a_known_place(spark):
    """The Greenwich meridian at 51.4779 N is 3 degrees west of zone 31's: easting 291,600, northing 5,707,000 within a pixel."""
    from forestflux.functions.grid import utm_forward

    e, n = spark.range(1).select(*utm_forward(F.lit(0.0), F.lit(3.0), F.lit(31))).first()
    assert (e, n) == pytest.approx((500000.0, 0.0), abs=1e-6)
    e, n = spark.range(1).select(*utm_forward(F.lit(43.642567), F.lit(-79.38714), F.lit(17))).first()
    assert (e, n) == pytest.approx((630084, 4833439), abs=2)


def test_missing_terrain(spark):
    from forestflux.operators import training

    df = training.with_terrain(spark.createDataFrame([(1.0, 2.0)], "lat double, lon double"), None)
    assert tuple(df.first()) == (1.0, 2.0, None, None, None)
