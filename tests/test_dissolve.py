"""Dissolved polygons keep area and membership, and shared borders vanish."""

import random

import pytest
from pyspark.sql import functions as F

from forestflux.operators import dissolve as D
from forestflux.operators import polygons
from forestflux.operators.polygons import Grid

SCHEMA = "id int, realm string, rings array<array<struct<x double, y double>>>"


def box(x0, y0, x1, y1, turn=False):
    ring = [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]
    return ring[::-1] if turn else ring


def rows_of(df):
    return {k: [[[(p.x, p.y) for p in ring] for ring in r.rings] for r in df.collect() if r.realm == k] for k in {r.realm for r in df.collect()}}


def test_shared_borders_cancel(spark):
    """Two halves, a third with a corner in the middle of their side, and a ring of boxes around a hole."""
    shapes = [
        (1, "a", [box(0, 0, 2, 4)]), (2, "a", [box(2, 0, 4, 4, True)]), (3, "a", [box(1, 4, 3, 6)]),
        *[(10 + i, "ring", [box(x, y, x + 1, y + 1, i % 2 == 0)]) for i, (x, y) in enumerate((x, y) for x in range(10, 13) for y in range(3) if (x, y) != (11, 1))],
        (30, None, [box(-3, -3, -1, -1), box(-2.5, -2.5, -2, -2)]),
        (40, "two", [box(20, 0, 21, 1)]), (41, "two", [box(21, 1, 22, 2)]),
    ]
    got = rows_of(D.dissolve(spark.createDataFrame(shapes, SCHEMA), "realm"))
    assert set(got) == {"a", "ring", "two", None}
    area = lambda parts: sum(sum(D._area(r) for r in part) for part in parts)
    assert [area(got[k]) for k in ("a", "ring", None, "two")] == [20.0, 8.0, 3.75, 2.0]
    assert len(got["a"]) == 1 and len(got["a"][0]) == 1
    assert len(got["ring"]) == 1 and sorted(map(len, got["ring"][0])) == [4, 12]
    assert len(got["two"]) == 2  # touching in a point is not sharing a border


def test_area_and_membership_stay(spark):
    """Random unions of grid boxes of unlike sizes, dealt to three keys."""
    r = random.Random(7)
    shapes, taken = [], set()
    for i in range(120):
        x, y, w, h = r.randrange(24), r.randrange(24), r.randint(1, 5), r.randint(1, 5)
        cells = {(a, b) for a in range(x, min(24, x + w)) for b in range(y, min(24, y + h))}
        if cells & taken:
            continue
        taken |= cells
        shapes.append((i, r.choice("pqr"), [box(x / 2, y / 2, min(24, x + w) / 2, min(24, y + h) / 2, r.random() < 0.5)]))
    layer = spark.createDataFrame(shapes, SCHEMA)
    grid = Grid(west=0.0, north=12.0, step=0.5, nlat=24, nlon=24)
    before = polygons.inside_runs(layer, grid).join(layer.select("id", "realm"), "id").select("realm", "iy", F.explode(F.sequence("ix0", "ix1")).alias("ix"))
    whole = D.dissolve(layer, "realm").withColumn("id", F.monotonically_increasing_id())
    whole = spark.createDataFrame(whole.collect(), whole.schema)  # ids stay
    after = polygons.inside_runs(whole, grid).join(whole.select("id", "realm"), "id").select("realm", "iy", F.explode(F.sequence("ix0", "ix1")).alias("ix"))
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    size = lambda df: {q.realm: q.s for q in polygons.share_runs(df, grid).join(df.select("id", "realm"), "id").groupBy("realm").agg(F.sum(F.col("share") * (F.col("ix1") - F.col("ix0") + 1)).alias("s")).collect()}
    a, b = size(layer), size(whole)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert whole.count() < layer.count()
