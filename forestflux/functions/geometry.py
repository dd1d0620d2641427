"""Points and polygons as plain expressions. A ring is array<struct<x, y>>, closed or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule by ray casting; points on the lower or left edge are inside, on the upper or right one outside."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["y"] <= y) != (b["y"] <= y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return spans & (at > x)

    hits = F.filter(F.sequence(F.lit(0), n - 1), crosses)
    return F.size(hits) % 2 == 1


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)}


def boxes_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)
