"""Predictions of many tree models in one pass: every row walks the trees of its own realm."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.setops import union_all
from .models import FEATURES, feature_rows

#: Bytes of trees that are sent to every task; beyond, realms are predicted one by one.
MAX_TREE_BYTES = 256 << 20
#: Rows that walk the trees at once.
ROWS = 2048

_LINE = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEeInfinityNa]+)\)|^(\s*)Predict: (\S+)|^\s*Tree (\d+)")


def tree_table(model: PipelineModel) -> dict[str, np.ndarray]:
    """The nodes of all trees of a fitted forest or boosted ensemble as arrays; a leaf's children are itself. roots and weights are by tree."""
    ensemble = model.stages[-1]
    boosted = "GBT" in type(ensemble).__name__
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    open_: list[tuple[int, bool]] = []  # nodes on the way down, and whether the right branch is next

    def add() -> int:
        here = len(feature)
        for column, x in ((feature, 0), (threshold, np.inf), (left, here), (right, here), (value, 0.0)):
            column.append(x)
        if open_ and not (roots and here == roots[-1]):
            parent, is_right = open_[-1]
            (right if is_right else left)[parent] = here
        return here

    for line in ensemble.toDebugString.splitlines():
        found = _LINE.match(line)
        if not found:
            continue
        if found[7] is not None:
            roots.append(len(feature))
            open_.clear()
        elif found[6] is not None:
            here = add()
            value[here] = float(found[6])
            # after a left leaf or a closed left branch comes the Else of the nearest node that has no right branch yet
            while open_ and open_[-1][1]:
                open_.pop()
        elif found[3] == "<=":
            here = add()
            feature[here], threshold[here] = int(found[2]), float(found[4])
            open_.append((here, False))
        else:
            open_[-1] = (open_[-1][0], True)
    weights = np.array(ensemble.treeWeights, float) if boosted else np.full(len(roots), 1.0 / len(roots))
    return {"feature": np.array(feature, np.int32), "threshold": np.array(threshold), "left": np.array(left, np.int32), "right": np.array(right, np.int32), "value": np.array(value), "roots": np.array(roots, np.int32), "weights": weights}


def walk(t: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Predictions for the rows of x."""
    out = np.empty(len(x))
    for a in range(0, len(x), ROWS):
        rows = x[a : a + ROWS]
        at = np.broadcast_to(t["roots"], (len(rows), len(t["roots"]))).copy()
        who = np.arange(len(rows))[:, None]
        while True:
            new = np.where(rows[who, t["feature"][at]] <= t["threshold"][at], t["left"][at], t["right"][at])
            if np.array_equal(new, at):
                break
            at = new
        out[a : a + ROWS] = t["value"][at] @ t["weights"]
    return out


def infer(df: DataFrame, models: dict[str, dict[str, PipelineModel]], features: list[str] = FEATURES, limit: int = MAX_TREE_BYTES) -> DataFrame:
    """(x, y, realm, <kind>...) of complete rows: for each kind of model (such as rf and xg) the prediction of the row's realm.

    One scan: the trees of all realms go to every task if they are small enough together, else each realm's rows are read for its own
    models. Infinite features count as missing; rows of realms without models are left out.
    """
    kinds = sorted({k for m in models.values() for k in m})
    clean = df.withColumns({c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c)) for c in features if c in df.columns})
    rows = feature_rows(clean, features, label=None).where(F.col("realm").isin(*models))
    tables = {r: {k: tree_table(m) for k, m in own.items()} for r, own in models.items()}
    size = sum(a.nbytes for own in tables.values() for t in own.values() for a in t.values())
    if size > limit:
        parts = []
        for r, own in models.items():
            part = rows.where(F.col("realm") == r).select("x", "y", "realm", *features)
            for k, m in own.items():
                part = m.transform(part).drop("features").withColumnRenamed("prediction", k)
            parts.append(part.select("x", "y", "realm", *[F.col(k) if k in own else F.lit(None).cast("double").alias(k) for k in kinds]))
        return union_all(parts)
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1)
            realm = np.array(batch.column("realm").to_pylist())
            out = {k: np.full(len(x), np.nan) for k in kinds}
            for r in np.unique(realm):
                here = np.flatnonzero(realm == r)
                for k, t in shared.value[r].items():
                    out[k][here] = walk(t, x[here])
            yield pa.record_batch([batch.column("x"), batch.column("y"), batch.column("realm"), *[pa.array(out[k], from_pandas=True) for k in kinds]], names=["x", "y", "realm", *kinds])

    kind_of = dict(rows.dtypes)
    schema = f"x {kind_of['x']}, y {kind_of['y']}, realm string, " + ", ".join(f"{k} double" for k in kinds)
    return rows.select("x", "y", "realm", *[F.col(f).cast("double") for f in features]).mapInArrow(run, schema)


def write_predictions(df: DataFrame, models: dict[str, dict[str, PipelineModel]], folder: str, year: int, scene: str, features: list[str] = FEATURES) -> dict[str, str]:
    """Writes x, y and biomass of a scene to <folder>/<kind>/<year>/<scene> for each kind; a scene without rows gives one row of NULLs."""
    spark = df.sparkSession
    kinds = sorted({k for m in models.values() for k in m})
    together = f"{folder.rstrip('/')}/.predicted/{year}/{scene}"
    infer(df, models, features).write.mode("overwrite").parquet(together)
    found = spark.read.parquet(together)
    if found.isEmpty():
        found = spark.createDataFrame([(None,) * len(found.columns)], found.schema)
    out = {k: f"{folder.rstrip('/')}/{k}/{year}/{scene}" for k in kinds}
    for k, path in out.items():
        found.select("x", "y", F.col(k).alias("biomass")).write.mode("overwrite").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(together)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return out
