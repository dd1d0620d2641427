"""Planted factors and sources come back; no row reaches the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forestflux.ml import factors

NAMES = [f"f{i}" for i in range(8)]


def frame(spark, x, parts=4):
    rows = [tuple(map(float, r)) for r in x] + [(None, *[1.0] * 7), (float("nan"), *[1.0] * 7)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES)).repartition(parts)


def test_planted_factors(spark):
    r = np.random.default_rng(1)
    load, noise = r.normal(size=(8, 2)) * 2, r.uniform(0.2, 1.0, 8)
    x = r.normal(size=(6000, 2)) @ load.T + r.normal(size=(6000, 8)) * np.sqrt(noise) + np.arange(8) * 1e4
    got = factors.factor_analysis(frame(spark, x), NAMES, 2)
    assert got.mean == pytest.approx(x.mean(0)) and got.noise == pytest.approx(noise, rel=0.15)
    assert got.loadings @ got.loadings.T == pytest.approx(load @ load.T, abs=0.45)
    model = got.loadings @ got.loadings.T + np.diag(got.noise)
    assert model == pytest.approx(np.cov(x.T, bias=True), abs=0.15)
    scores = frame(spark, x).dropna().where(~F.isnan("f0")).select(*got.columns()).agg(F.corr("factor_1", "factor_2"), F.avg("factor_1"), F.var_pop("factor_1")).first()
    assert abs(scores[0]) < 0.1 and abs(scores[1]) < 1e-6 and 0.8 < scores[2] < 1.05


def test_independent_sources(spark):
    r = np.random.default_rng(2)
    s = np.stack([np.sign(r.normal(size=5000)), r.uniform(-1.7, 1.7, 5000), r.laplace(size=5000)], 1)
    mix = r.normal(size=(8, 3))
    df = frame(spark, s @ mix.T + 5)
    got = factors.independent_components(df, NAMES, 3)
    found = np.array([list(q) for q in df.dropna().where(~F.isnan("f0")).select(*got.columns()).collect()])
    again = np.array([list(q) for q in df.dropna().where(~F.isnan("f0")).select(*NAMES).collect()])
    truth = (again - 5) @ np.linalg.pinv(mix).T
    near = np.abs(np.corrcoef(found.T, truth.T)[:3, 3:])
    assert (near.max(1) > 0.99).all() and sorted(near.argmax(1)) == [0, 1, 2]
    left = np.array([list(q) for q in df.dropna().where(~F.isnan("f0")).select(*got.without([0, 1, 2])).collect()])
    assert left == pytest.approx(np.broadcast_to(got.mean, left.shape), abs=1e-6)  # with all components gone the means stay


def test_no_rows_and_too_many_components(spark):
    with pytest.raises(ValueError, match="no complete rows"):
        factors.factor_analysis(frame(spark, np.zeros((0, 8))), NAMES, 1)
    flat = np.outer(np.arange(50.0), np.ones(8))
    with pytest.raises(ValueError, match="fewer than"):
        factors.independent_components(frame(spark, flat), NAMES, 2)
