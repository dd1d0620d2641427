"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size, at most `most` (2 by default). Its whole
part is taken surely; the fractional parts are rounded in pairs: mass moves at random from one of two documents to the other until
one of them is 0 or 1, and the other meets the next document. Documents meet in order of size, so what one gains another of nearly
the same size loses, and the words taken stay near the target.

Leaves are buckets of a hash of the document, so that a source with a third of all rows is spread like any other; each leaf leaves at
most one unfinished document per source. These residuals meet in a reduction tree of fixed fan-in, level by level, until one is left
per source, which is rounded alone. All chances are hashes of ids and a seed: reruns and repeated tasks agree.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; repeated rows are
told apart by their number among equals; an empty table gives an empty result; other columns are kept out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

WEIGHTS = (3.0, 1.0, 2.0)
WORDS = r"[^\x20\x09-\x0D]+"
#: Documents in a leaf of the reduction tree, and nodes that meet in one node above.
LEAF_ROWS, FAN_IN = 20_000, 32
#: Sources are metadata: their sizes are balanced on the driver up to this many.
MAX_SOURCES = 1_000_000
_EDGE = 1e-9


def targets_of(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> dict[str | None, float]:
    """Words to take from each source: share of all sizes by weight, stopped at most * size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: cap[s] for s in above}
        left -= sum(cap[s] for s in above)
        open_ = [s for s in open_ if s not in set(above)]
    return out


def _chances(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from the keys alone."""
    from .common import mix64

    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return (mix64(x) >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(p: np.ndarray, u: np.ndarray, last: bool) -> np.ndarray:
    """Sequential pivotal rounding of probabilities in the order given; one entry may stay between 0 and 1 unless last."""
    p = p.astype(np.float64).copy()
    held = -1
    for i in range(len(p)):
        if p[i] <= _EDGE or p[i] >= 1 - _EDGE:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, s = p[held], p[i], p[held] + p[i]
        if s < 1:  # one of the two drops to 0
            if u[i] * s < b:
                p[held], p[i], held = 0.0, s, i
            else:
                p[held], p[i] = s, 0.0
        else:  # one of the two rises to 1
            if u[i] * (2 - s) < 1 - b:
                p[held], p[i], held = 1.0, s - 1, i
            else:
                p[held], p[i] = s - 1, 1.0
        if held >= 0 and (p[held] <= _EDGE or p[held] >= 1 - _EDGE):
            p[held], held = round(p[held]), -1
    if last and held >= 0:
        p[held] = 1.0 if u[held] < p[held] else 0.0
    return p


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 1, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, nth, size, source, source_size, target, copies, taken) for every row; nth counts rows with the same doc_id and text."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text", "source").alias("key"))
    same = Window.partitionBy("key", "doc_id").orderBy("source", "size")
    sized = table(sized.withColumn("nth", F.row_number().over(same).cast("long")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = targets_of([(r["source"], r["n"]) for r in found], share, most, weights)
    facts = spark.createDataFrame(
        [(r["source"], r["n"], float(target[r["source"]]), float(target[r["source"]] / r["n"]) if r["n"] else 0.0) for r in found],
        "source string, source_size long, target double, rate double",
    )
    leaves = max(1, -(-sum(r["rows"] for r in found) // leaf_rows))
    rows = sized.join(F.broadcast(facts), sized["source"].eqNullSafe(facts["source"]), "left").drop(facts["source"])
    rows = rows.withColumn("key", F.xxhash64("key", "nth")).withColumn("node", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(leaves)))
    rows = rows.select("doc_id", "nth", "size", "source", "source_size", "target", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), "key", "node")

    def rounder(level: int, last: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["source", "size", "key"], na_position="last", kind="stable").reset_index(drop=True)
            u, p = _chances(group["key"].to_numpy(), seed + 1 + level), group["p"].to_numpy(np.float64)
            names = group["source"].fillna("").to_numpy()
            gaps = np.flatnonzero((names[1:] != names[:-1]) | (group["source"].isna().to_numpy()[1:] != group["source"].isna().to_numpy()[:-1])) + 1 if len(names) else []
            for a, b in zip([0, *gaps], [*gaps, len(names)]):
                p[a:b] = pivot(p[a:b], u[a:b], last)
            return group.assign(p=p, node=group["node"] // fan_in)

        return run

    done, level = None, 0
    while True:
        last = leaves == 1
        rounded = table(rows.groupBy("node").applyInPandas(rounder(level, last), rows.schema), f"mix-level{level}")
        over = (F.col("p") == 0) | (F.col("p") == 1)
        ended = rounded if last else rounded.where(over)
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        rows, leaves, level = rounded.where(~over), -(-leaves // fan_in), level + 1
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select("doc_id", "nth", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns of docs stay as they are."""
    mixed = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias("__d"), F.col("nth").alias("__n"), F.col("copies").alias("__c"), F.col("key").alias("__k"))
    keyed = docs.withColumn("__h", F.xxhash64("doc_id", "text", "source"))
    same = Window.partitionBy("__h", "doc_id").orderBy("source")
    keyed = keyed.withColumn("__i", F.row_number().over(same).cast("long")).withColumn("__h", F.xxhash64("__h", "__i"))
    out = keyed.join(mixed, (keyed["__h"] == mixed["__k"]) & (keyed["__i"] == mixed["__n"]) & keyed["doc_id"].eqNullSafe(mixed["__d"]))
    return out.withColumn("__e", F.explode(F.sequence(F.lit(1), F.col("__c")))).select(*[F.col(f"`{c}`") for c in docs.columns])
