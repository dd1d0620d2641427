"""Conservative resampling, projections, bands and target grids."""

import random

import pytest
from pyspark.sql import functions as F

from forestflux.functions import grid
from forestflux.operators import regrid, scenes
from forestflux.operators.polygons import Grid


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_regrid_keeps_totals_and_means(spark):
    r = random.Random(1)
    source, target = Grid(-10.0, 50.0, 1.0, 30, 40), Grid(-11.0, 51.5, 0.7, 47, 61)
    rows = [(y, x, r.choice(["a", "b"]), r.uniform(-5, 5) if r.random() > 0.1 else None) for y in range(30) for x in range(40)]
    df = spark.createDataFrame(rows, "iy int, ix int, k string, v double")
    got = {(p.iy, p.ix, p.k): p.v for p in regrid.regrid(df, source, target, ["v"], keys=("k",)).collect()}
    want = {}
    for y, x, k, v in rows:
        for ty in range(47):
            h = max(0.0, min(50.0 - y, 51.5 - 0.7 * ty) - max(49.0 - y, 51.5 - 0.7 * (ty + 1)))
            for tx in range(61) if h > 1e-9 else ():
                w = max(0.0, min(x - 9.0, -11.0 + 0.7 * (tx + 1)) - max(x - 10.0, -11.0 + 0.7 * tx))
                if w > 1e-9:
                    want[ty, tx, k] = want.get((ty, tx, k), 0.0) + (v or 0.0) * h * w
    assert got.keys() == want.keys() and all((got[c] or 0.0) == pytest.approx(want[c], abs=1e-9) for c in want)
    assert sum(v or 0.0 for v in got.values()) == pytest.approx(sum(v or 0.0 for *_, v in rows), abs=1e-9)
    ones = df.select("iy", "ix", F.lit(3.0).alias("v"))
    assert {round(p.v, 9) for p in regrid.regrid(ones, source, target, ["v"], how="mean", sphere=True).collect()} == {3.0}
    total = regrid.regrid(ones, source, target, ["v"], sphere=True).agg(F.sum("v")).first()[0]
    assert total == pytest.approx(3.0 * 1200, rel=1e-12)
    assert regrid.regrid(ones, source, Grid(100.0, 0.0, 1.0, 5, 5), ["v"]).count() == 0
    with pytest.raises(NotImplementedError):
        regrid.regrid(ones, source, target, ["v"], how="max")


def test_tiles(spark):
    g = Grid(-180.0, 90.0, 0.25, 720, 1440)
    df = spark.createDataFrame([(0, 0), (39, 39), (40, 40), (359, 719), (360, 720), (719, 1439)], "iy int, ix int")
    got = [tuple(r) for r in regrid.into_tiles(df, g).select("tile_id", "iy", "ix").collect()]
    assert got == [("90N_180W", 0, 0), ("90N_180W", 39, 39), ("80N_170W", 0, 0), ("10N_010W", 39, 39), ("00N_000E", 0, 0), ("80S_170E", 39, 39)]
    with pytest.raises(ValueError):
        regrid.into_tiles(df, Grid(0.0, 0.0, 0.3, 1, 1))


def test_known_projections(spark):
    """Published coordinates, and both directions over all zones and latitudes to a tenth of a millimetre."""
    east, north = one(spark, *grid.utm_forward(F.lit(51.2), F.lit(7.5), F.lit(32)))
    assert east == pytest.approx(395201.3103811303, abs=2e-3) and north == pytest.approx(5673135.241182375, abs=2e-3)
    df = spark.range(0, 200_000, 7).select((F.col("id") * 7919 % 16401 / 100.0 - 80).alias("lat"), (F.col("id") * 104729 % 36000 / 100.0 - 180).alias("lon"))
    df = df.withColumn("zone", grid.utm_zone(F.col("lon")))
    east, north = grid.utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    df = df.withColumns({"e": east, "n": north})
    lat, lon = grid.utm_inverse(F.col("e"), F.col("n"), F.col("zone"))
    metres = 111_320.0
    worst = df.agg(F.max(F.abs(lat - F.col("lat")) * metres), F.max(F.abs(lon - F.col("lon")) * metres * F.cos(F.radians("lat"))), F.min("zone"), F.max("zone")).first()
    assert worst[0] < 1e-4 and worst[1] < 1e-4 and (worst[2], worst[3]) == (1, 60)


def test_bands(spark):
    spans = lambda a, b: one(spark, grid.spans_band_edge(F.lit(float(a)), F.lit(float(b))))[0]
    assert [spans(*x) for x in ((1, 7), (1, 9), (0, 8), (-80, -72), (8, 8), (71, 73), (73, 83.9), (83, 84.5))] == [False, True, False, False, True, True, False, True]


def test_no_corner_agrees(spark):
    row = {f"{c}_{a}": v for c, lat in (("ur", 9.0), ("ul", 9.0), ("ll", 7.0), ("lr", 7.0)) for a, v in (("lat", lat), ("lon", 3.0), ("x", 0.0), ("y", 0.0))}
    df = spark.createDataFrame([row])
    with pytest.raises(Exception, match="no corner"):
        df.select(scenes.zone_letter(F.lit(31))).collect()


SCENE = "scene_id string, zone int, south boolean, east0 double, north0 double, step double, nrow int, ncol int"


def test_footprints_over_the_antimeridian(spark):
    layout = spark.createDataFrame([("over", 1, False, 270000.0, 6900000.0, 30.0, 7000, 8000), ("in", 33, True, 450000.0, 8600000.0, 30.0, 7000, 8000), ("beyond", 1, False, 60000.0, 6900000.0, 30.0, 7000, 5000), ("edge", 60, False, 560000.0, 7200000.0, 30.0, 7000, 8000)], SCENE)
    got = {(r.scene_id, r.side): r for r in scenes.footprints(layout).collect()}
    assert set(got) == {("over", "east"), ("over", "west"), ("in", "whole"), ("beyond", "whole"), ("edge", "east"), ("edge", "west")}
    assert all(r.max_lon == 180 and r.min_lon > 170 if side == "east" else side == "whole" or (r.min_lon == -180 and r.max_lon < -170) for (_, side), r in got.items())
    assert 170 < got["beyond", "whole"].min_lon < got["beyond", "whole"].max_lon < 180  # all of it east of the antimeridian
    inside = got["in", "whole"]
    assert -15 < inside.min_lat < inside.max_lat < -12 and 14 < inside.min_lon < inside.max_lon < 17


def test_every_cell_of_a_scene_is_found_once(spark):
    """By each cell of a wide surrounding, whether its pixel is in the scene."""
    layout = spark.createDataFrame([("over", 1, False, 270000.0, 6900000.0, 5000.0, 30, 30)], SCENE)
    step = 0.1
    got = [(r.side, r.iy, r.ix) for r in scenes.target_cells(layout, step).collect()]
    assert len(got) == len(set(got))
    wide = spark.range(300 * 3600).select((F.col("id") / 3600 + 200).cast("int").alias("iy"), (F.col("id") % 3600).cast("int").alias("ix"))
    lat, lon = F.lit(90.0) - (F.col("iy") + 0.5) * step, (F.col("ix") + 0.5) * step - 180
    east, north = grid.utm_forward(lat, F.when(lon > 0, lon - 360).otherwise(lon), F.lit(1))
    near = F.when(F.abs(F.when(lon > 0, lon - 360).otherwise(lon) + 177) < 20, True).otherwise(False)
    row, col = F.floor((6900000.0 - north) / 5000.0 + 0.5), F.floor((east - 270000.0) / 5000.0 + 0.5)
    want = wide.where(near & row.between(0, 29) & col.between(0, 29)).select(F.when(lon > 0, "east").otherwise("west"), "iy", "ix").collect()
    assert sorted(got) == sorted(map(tuple, want)) and {s for s, *_ in got} == {"east", "west"}
