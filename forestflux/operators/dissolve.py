"""Union of the polygons of a key: borders that two of them share cancel, and what is left is chained to rings."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .polygons import edges

#: Width of the cells in which vertices and edges meet, in units of the coordinates.
CELL = 1.0
#: Distance from an edge, as a part of its length, at which a vertex lies on it.
ON_EDGE = 1e-12
RINGS = "array<array<struct<x:double,y:double>>>"


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int"))


def noded(found: DataFrame, cell: float = CELL) -> DataFrame:
    """Edges (key, x0, y0, x1, y1) cut at all vertices of the same key that lie on them, so that shared borders consist of equal pieces.

    Edges and vertices meet in cells by an equi-join; an edge's row is put into the cells of its columns and the rows it passes there.
    """
    found = found.withColumn("__e", F.monotonically_increasing_id() if "edge" not in found.columns else F.col("edge"))
    corners = found.select("key", F.col("x0").alias("x"), F.col("y0").alias("y")).distinct()
    corners = corners.withColumns({"cx": F.floor(F.col("x") / cell).cast("int"), "cy": F.floor(F.col("y") / cell).cast("int")})
    wide = found.withColumn("cx", F.explode(_cells(F.least("x0", "x1"), F.greatest("x0", "x1"), cell)))
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    at = lambda x: F.coalesce(F.col("y0") + (x - F.col("x0")) * slope, F.col("y0"))
    west = F.greatest(F.least("x0", "x1"), F.col("cx") * cell)
    east = F.least(F.greatest("x0", "x1"), (F.col("cx") + 1) * cell)
    upright = F.col("x0") == F.col("x1")
    a, b = F.when(upright, F.col("y0")).otherwise(at(west)), F.when(upright, F.col("y1")).otherwise(at(east))
    margin = cell * 1e-9
    tall = wide.withColumn("cy", F.explode(_cells(F.least(a, b) - margin, F.greatest(a, b) + margin, cell)))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    along = ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / square
    off = F.abs((F.col("x") - F.col("x0")) * dy - (F.col("y") - F.col("y0")) * dx) / square
    hits = tall.join(corners, ["key", "cx", "cy"]).where((along > ON_EDGE) & (along < 1 - ON_EDGE) & (off <= ON_EDGE))
    cuts = hits.groupBy("__e").agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), "x", "y"))).alias("cuts"))
    first, last = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))), F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    inner = F.coalesce(F.transform("cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))
    line = F.concat(first, inner, last)
    pieces = found.join(cuts, "__e", "left").select("key", line.alias("line"))
    pieces = pieces.select("key", F.explode(F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))).alias("p"))
    return pieces.select("key", F.col("p.a.x").alias("x0"), F.col("p.a.y").alias("y0"), F.col("p.b.x").alias("x1"), F.col("p.b.y").alias("y1"))


def outline(polygons: DataFrame, key: str, cell: float = CELL) -> DataFrame:
    """Border pieces (key, x0, y0, x1, y1) of the union, which lies to the left of each; sums cancel pieces that are there both ways."""
    keyed = polygons.select("id", F.col(key).alias("key")).distinct()
    every = edges(polygons).join(keyed, "id")
    turned = F.col("sign") > 0
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    own = every.select("key", pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"))
    own = own.withColumn("edge", F.struct("key", "x0", "y0", "x1", "y1"))
    pieces = noded(own.dropDuplicates(["edge"]), cell)
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    sums = pieces.groupBy("key", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(F.when(a < b, 1).otherwise(-1)).alias("way")).where("way <> 0")
    start, end = F.when(F.col("way") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("way") > 0, F.col("b")).otherwise(F.col("a"))
    return sums.select("key", start.alias("s"), end.alias("e")).select("key", F.col("s.x").alias("x0"), F.col("s.y").alias("y0"), F.col("e.x").alias("x1"), F.col("e.y").alias("y1"))


def _area(ring: list) -> float:
    ox, oy = ring[0]
    return sum((a[0] - ox) * (b[1] - oy) - (b[0] - ox) * (a[1] - oy) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _turn(a: tuple, b: tuple, c: tuple) -> tuple:
    """Order of the ways on from b after a, the sharpest turn to the right last."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    cross, dot = ux * vy - uy * vx, ux * vx + uy * vy
    return (1, -dot) if cross > 0 else (0, 0) if cross == 0 and dot > 0 else (-1, dot)


def chain(pieces: list[tuple]) -> list[list[list[tuple]]]:
    """Polygons (a shell and its holes) out of directed pieces ((x, y), (x, y)). Where rings touch in a point, each keeps to its left."""
    ways = defaultdict(list)
    for a, b in pieces:
        ways[a].append(b)
    shells, holes = [], []
    while ways:
        start = min(ways)
        ring, before = [start], (start[0] - 1.0, start[1])
        while True:
            here = ring[-1]
            onward = ways[here]
            k = max(range(len(onward)), key=lambda i: _turn(before, here, onward[i]))
            there = onward.pop(k)
            if not onward:
                del ways[here]
            if there == start:
                break
            ring.append(there)
            before = here
        (shells if _area(ring) > 0 else holes).append(ring)
    out = [[s] for s in shells]
    sizes = [_area(s) for s in shells]
    for hole in holes:
        x, y = min(hole)
        inside = []
        for i, s in enumerate(shells):
            if (x, y) in s:  # touches in its westernmost point: decided by the piece that leaves it
                k = hole.index((x, y))
                nx, ny = hole[(k + 1) % len(hole)]
                x_, y_ = (x + nx) / 2, (y + ny) / 2
            else:
                x_, y_ = x, y
            odd = False
            for (ax, ay), (bx, by) in zip(s, s[1:] + s[:1], strict=True):
                if (ay <= y_) != (by <= y_) and ax + (y_ - ay) * (bx - ax) / (by - ay) > x_:
                    odd = not odd
            if odd:
                inside.append(i)
        out[min(inside, key=lambda i: sizes[i])].append(hole)
    return out


def dissolve(polygons: DataFrame, key: str, cell: float = CELL) -> DataFrame:
    """(key, rings): the union of each key's polygons, which may share borders but not overlap; a row per part, its shell first.

    Corners in straight sides stay. Null keys are a key. The chaining sees one key's outline, which is what its rows hold.
    """
    kind = dict(polygons.dtypes)[key]

    def rings(part: pd.DataFrame) -> pd.DataFrame:
        pieces = list(zip(zip(part.x0, part.y0, strict=True), zip(part.x1, part.y1, strict=True), strict=True))
        found = [[[{"x": x, "y": y} for x, y in ring] for ring in shape] for shape in chain(pieces)]
        return pd.DataFrame({"key": [part.key.iloc[0]] * len(found), "rings": found})

    return outline(polygons, key, cell).groupBy("key").applyInPandas(rings, f"key {kind}, rings {RINGS}").withColumnRenamed("key", key)
