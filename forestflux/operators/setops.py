"""Unions, mosaics, overlap groups and tile sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mosaic(frames: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """One row per key, of the first frame that has it."""
    rows = union_all([f.select(*keys, *values).withColumn("__source", F.lit(i)) for i, f in enumerate(frames)])
    best = rows.groupBy(*keys).agg(F.min(F.struct("__source", *values)).alias("__m"))
    return best.select(*keys, *[F.col("__m")[v].alias(v) for v in values])


def overlap_groups(coordinates: list[set]) -> list[list[int]]:
    """Groups data sets by overlapping coordinates in one pass: each joins the first group it overlaps, and groups never merge."""
    groups: list[tuple[set, list[int]]] = []
    for i, own in enumerate(coordinates):
        for seen, members in groups:
            if seen & own:
                seen |= own
                members.append(i)
                break
        else:
            groups.append((set(own), [i]))
    return [members for _, members in groups]


def tiles_for_box(spark, min_lat: float, max_lat: float, min_lon: float, max_lon: float, size: int = 10) -> DataFrame:
    """(lat, lon) of the upper-left corners of the tiles that cover a box.

    A box that starts on a tile edge in the south, or ends on one in the east, does not take the tile beyond.
    """
    from math import ceil, floor

    top, bottom = ceil(max_lat / size) * size, ceil(min_lat / size) * size + (size if min_lat % size == 0 else 0)
    left, right = floor(min_lon / size) * size, floor(max_lon / size) * size - (size if max_lon % size == 0 else 0)
    one = spark.range(1)
    lats = one.select(F.explode(F.sequence(F.lit(min(top, bottom)), F.lit(top), F.lit(size))).alias("lat"))
    return lats.withColumn("lon", F.explode(F.sequence(F.lit(left), F.lit(max(left, right)), F.lit(size))))
