"""Points in polygons, runs of cells and clipped shares against ray casting and clipping in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forestflux.operators import joins, polygons
from forestflux.operators.polygons import Grid

SCHEMA = "id int, rings array<array<struct<x double, y double>>>"


def inside(x, y, rings):
    """The even-odd rule of the module, vertex by vertex."""
    odd = np.zeros(len(x), int)
    for ring in rings:
        r = np.array(ring)
        for (x0, y0), (x1, y1) in zip(r, np.roll(r, -1, axis=0), strict=True):
            over = (y0 <= y) != (y1 <= y)
            if over.any():
                at = x0 + (y - y0) * (x1 - x0) / ((y1 - y0) or 1.0)
                odd += over & (at > x)
    return odd % 2 == 1


def clipped_area(ring, x0, y0, x1, y1):
    """Area of a ring within a box, with a sign, clipped side by side."""
    pts = [tuple(p) for p in ring]
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(pts, pts[1:] + pts[:1], strict=True):
            ia, ib = (a[axis] - bound) * keep >= 0, (b[axis] - bound) * keep >= 0
            if ia:
                out.append(a)
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(a[k] + t * (b[k] - a[k]) if k != axis else bound for k in (0, 1)))
        pts = out
        if not pts:
            return 0.0
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True)) / 2


def star(r, cx, cy, size, n, turn=1):
    at = sorted(r.random() for _ in range(n))
    return [(cx + size * d * math.cos(2 * math.pi * a * turn), cy + size * d * math.sin(2 * math.pi * a * turn)) for a in at for d in [r.uniform(0.3, 1)]]


@pytest.fixture(scope="module")
def layer():
    r = random.Random(2)
    rows = [(i, [star(r, r.uniform(-40, 40), r.uniform(-30, 30), size, n, r.choice([1, -1]))]) for i, (size, n) in enumerate([(30, 9), (25, 60), (3, 40), (0.4, 30), (40, 400), (0.01, 12)])]
    rows.append((10, [[(0, 0), (16, 0), (16, 16), (0, 16)], [(4, 4), (4, 8), (8, 8), (8, 4)]]))  # on the edges of cells, with a hole
    rows.append((11, [[(-5, -5), (-1, -5), (-1, -1), (-5, -1), (-5, -5)]]))  # closed
    rows.append((11, [[(20, -20), (30, -20), (25, -10)]]))  # a further part
    rows.append((12, []))
    rows.append((13, None))
    return [(i, [[(float(x), float(y)) for x, y in ring] for ring in rings] if rings is not None else None) for i, rings in rows]


def test_points(spark, layer):
    """Random points, vertices of the grid of cells and points on edges; columns that clash with the cover's."""
    r = random.Random(4)
    points = [(r.uniform(-50, 50), r.uniform(-45, 45)) for _ in range(1500)] + [(float(x), float(y)) for x in range(-6, 20, 2) for y in range(-6, 20, 2)]
    points += [(x / 4, y / 4) for x in range(-24, 70, 3) for y in (0, 16, 32, 64)]
    df = spark.createDataFrame([(k, x, y, -1) for k, (x, y) in enumerate(points)] + [(-1, None, 1.0, -1)], "k int, x double, y double, level int")
    got = sorted((row.k, row.id) for row in polygons.points_in(df, spark.createDataFrame(layer, SCHEMA), "x", "y").collect())
    x, y = np.array(points).T
    want = sorted((int(k), i) for i, rings in layer if rings for k in np.flatnonzero(inside(x, y, rings)))
    assert got == want


def test_joins_keep_other_columns(spark, layer):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (5.0, 5.0, "b"), (-3.0, -3.0, "c")], "x double, y double, cx string")
    shapes = spark.createDataFrame(layer, SCHEMA).where("id in (10, 11)").withColumn("code", F.concat(F.lit("p"), "id"))
    found = joins.points_in_polygons(df, shapes, "x", "y")
    assert sorted(map(tuple, found.collect())) == [(-3.0, -3.0, "c", 11, "p11"), (1.0, 1.0, "a", 10, "p10")]


def test_hundred_thousand_vertices(spark):
    """A ring of 100,000 vertices with a hole: the cover's rows hold the edges of one cell, a small part of all."""
    n = 100_000

    def circle(m, size):
        return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct((size * F.cos(2 * math.pi * i / m)).alias("x"), (size * F.sin(2 * math.pi * i / m)).alias("y")))

    shape = spark.range(1).select(F.lit(1).alias("id"), F.array(circle(n, 9.0), circle(n // 10, 4.0)).alias("rings"))
    cover = polygons.cover(shape).select(F.size("edges").alias("n"), "level").toPandas()
    assert cover.n.max() < n / 100 and cover.n.isna().sum() > 50 and cover.level.nunique() > 3
    r = np.random.default_rng(1)
    x, y = r.uniform(-10, 10, (2, 3000))
    got = {row.k for row in polygons.points_in(spark.createDataFrame(list(zip(range(3000), x.tolist(), y.tolist())), "k int, x double, y double"), shape, "x", "y").collect()}
    d = np.hypot(x, y)
    sure = np.abs(d - 9) > 1e-6
    assert {k for k in got if sure[k]} == set(np.flatnonzero((d < 9) & (d > 4) & sure).tolist())


GRID = Grid(west=-20.0, north=24.0, step=0.5, nlat=70, nlon=80)


def test_runs_of_centres(spark, layer):
    iy, ix = np.divmod(np.arange(70 * 80), 80)
    cells = spark.createDataFrame([(int(a), int(b)) for a, b in zip(iy, ix, strict=True)], "iy int, ix int")
    shapes = spark.createDataFrame(layer, SCHEMA)
    runs = polygons.inside_runs(shapes, GRID)
    got = sorted(map(tuple, polygons.cells_in_runs(cells, runs, block=16).collect()))
    x, y = -20 + (ix + 0.5) * 0.5, 24 - (iy + 0.5) * 0.5
    want = sorted((int(iy[k]), int(ix[k]), i) for i, rings in layer if rings for k in np.flatnonzero(inside(x, y, rings)))
    assert got == want
    least = {}
    for a, b, i in want:
        least[a, b] = min(i, least.get((a, b), i))
    assert {(r.iy, r.ix): r.region for r in polygons.mask(cells, shapes, GRID).collect() if r.region is not None} == least


def test_shares(spark, layer):
    """Shares of every cell of several polygons, and totals of whole ones."""
    grid = Grid(west=-12.0, north=18.0, step=1.0, nlat=36, nlon=30)
    picked = [row for row in layer if row[0] in (2, 3, 5, 10, 11)] + [(20, [[(-40.0, -3.3), (40.0, -3.3), (40.0, 2.25), (-40.0, 2.25)]])]
    got = {}
    for r in polygons.share_runs(spark.createDataFrame(picked, SCHEMA), grid).collect():
        for ix in range(r.ix0, r.ix1 + 1):
            got[r.id, r.iy, ix] = got.get((r.id, r.iy, ix), 0) + r.share
    for iy in range(36):
        for ix in range(30):
            for i in {i for i, _ in picked}:
                want = 0.0
                for j, rings in picked:
                    if j == i:
                        for k, ring in enumerate(rings):
                            want += abs(clipped_area(ring, ix - 12.0, 17.0 - iy, ix - 11.0, 18.0 - iy)) * (1 if k == 0 else -1)
                if i not in (2, 3, 5):  # the clipping above is right for convex rings only
                    assert got.get((i, iy, ix), 0.0) == pytest.approx(want, abs=1e-9)
    whole = Grid(west=-90.0, north=90.0, step=0.25, nlat=720, nlon=720)
    cells = spark.range(720 * 720).select((F.col("id") / 720).cast("int").alias("iy"), (F.col("id") % 720).cast("int").alias("ix"), F.lit(2.0).alias("v"))
    sums = {r.id: r for r in polygons.clipped_sums(cells, spark.createDataFrame(layer, SCHEMA), whole, ["v"]).collect()}
    for i in {i for i, rings in layer if rings}:
        area = sum(abs(clipped_area(ring, -999, -999, 999, 999)) * (1 if k == 0 else -1) for j, rings in layer if j == i for k, ring in enumerate(rings))
        assert sums[i].inside / 16 == pytest.approx(area, rel=1e-9) and sums[i].v == pytest.approx(2 * sums[i].inside)


def test_plan_holds_no_rings(spark, layer):
    cells = spark.createDataFrame([(0, 0)], "iy int, ix int")
    plan = polygons.mask(cells, spark.createDataFrame(layer, SCHEMA), GRID)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
