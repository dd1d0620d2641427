"""Connected components of a link table by repeated contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b).

    In each round every node points to the neighbour with the least hash, if that is less than its own; links then join what their
    ends point to. A round's hash is new, so chains shrink by a constant factor whatever their ids. Hot nodes are combined map-side.
    """
    now = table(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    labels, step = None, 0
    while True:
        rank = lambda c, step=step: F.xxhash64(c, F.lit(step))
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        step_up = least.select(F.col("a").alias("u"), F.when(F.col("m.h") < rank("a"), F.col("m.v")).otherwise(F.col("a")).alias("p"))
        parent = table(step_up, "parents")
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = table(parent.join(above, "p").select("u", F.col("q").alias("p")), "parents")  # two steps at once
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(parent, labels["root"] == parent["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = table(labels, "labels")
        a, b = parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        now = table(now.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
        step += 1
        if now.isEmpty():
            return labels
