"""One-pass inference against the models' own predictions."""

import random

import pytest
from pyspark.sql import functions as F

from forestflux.ml import models, trees
from forestflux.operators import training

NAMES = ["SR_B4", "NDVI", "NIR_V", "tavg"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(1)
    rows = [(float(i), float(-i), r.choice(["east", "west", "none"]), r.uniform(0, 1), r.uniform(-1, 1), r.randint(-5, 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, y double, realm string, SR_B4 double, NDVI double, tavg int")
    return df.withColumn("biomass", 100 * F.col("SR_B4") + F.when(F.col("NDVI") > 0.2, 30).otherwise(0) + F.col("tavg")).repartition(3)


@pytest.fixture(scope="module")
def fitted(data):
    own = lambda r: models.feature_rows(data.where(F.col("realm") == r), NAMES)
    return {r: {"rf": models.random_forest(own(r), NAMES, trees=7, depth=6), "xg": models.gradient_boost(own(r), NAMES, trees=6, depth=4)} for r in ("east", "west")}


def test_equal_to_each_models_transform(data, fitted):
    rows = models.feature_rows(data, NAMES, label=None)
    want = {}
    for r, own in fitted.items():
        for k, m in own.items():
            for p in m.transform(rows.where(F.col("realm") == r)).collect():
                want.setdefault((p.x, r), {})[k] = p.prediction
    for limit in (trees.MAX_TREE_BYTES, 0):
        got = {(p.x, p.realm): {"rf": p.rf, "xg": p.xg} for p in trees.infer(data, fitted, NAMES, limit).collect()}
        assert got.keys() == want.keys() and "none" not in {r for _, r in got}
        assert all(got[i][k] == pytest.approx(want[i][k], rel=1e-12) for i in got for k in ("rf", "xg"))


def test_one_scan(data, fitted, tmp_path):
    data.write.parquet(str(tmp_path / "rows"))
    plan = trees.infer(data.sparkSession.read.parquet(str(tmp_path / "rows")), fitted, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_missing_and_infinite_values(spark, fitted):
    rows = [(1.0, 1.0, "east", 0.5, 0.1, 3), (2.0, 2.0, "east", None, 0.1, 3), (3.0, 3.0, "west", float("inf"), 0.1, 3), (4.0, 4.0, "west", float("nan"), 0.1, 3), (5.0, 5.0, None, 0.5, 0.1, 3)]
    df = spark.createDataFrame(rows, "x double, y double, realm string, SR_B4 double, NDVI double, tavg int")
    assert [r.x for r in trees.infer(df, fitted, NAMES).collect()] == [1.0]


def test_written_predictions(spark, data, fitted, tmp_path):
    paths = trees.write_predictions(data, fitted, str(tmp_path), 2014, "045030", NAMES)
    assert sorted(paths) == ["rf", "xg"] and spark.read.parquet(paths["rf"]).count() == data.where("realm <> 'none'").count()
    empty = trees.write_predictions(data.where("x < 0"), fitted, str(tmp_path), 2015, "045030", NAMES)
    assert [tuple(r) for r in spark.read.parquet(empty["xg"]).collect()] == [(None, None, None)]


def test_model_of_all_features_from_training_rows(spark):
    """The training job's columns are those that the models ask for."""
    r = random.Random(2)
    pixels = spark.createDataFrame([(i, j, *[r.uniform(0.1, 5) for _ in models.FEATURES]) for i in range(6) for j in range(6)], "iy int, ix int, " + ", ".join(f"{c} double" for c in models.FEATURES))
    shots = spark.createDataFrame([(float(k % 50), False, 450, 0.5 + k % 6, 0.5 + k // 6 % 6) for k in range(72)], "biomass double, burned boolean, ecoregion int, lat double, lon double")
    rows = training.training_rows(shots, pixels, (0, 9, 0, 9), models.FEATURES, 0.5, 1.0, 6, 0.5, 1.0, 6)
    assert len(models.FEATURES) == 38 and set(models.FEATURES) <= set(rows.columns)
    model = models.random_forest(models.feature_rows(rows), trees=3, depth=3)
    found = trees.infer(rows.withColumns({"x": F.col("lon"), "y": F.col("lat")}), {"neotropic": {"rf": model}}).collect()
    assert len(found) == 72 and all(p.rf is not None for p in found)
    assert len(models.importances(model, models.FEATURES)) == 38
