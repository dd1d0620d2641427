"""Rank-one updates, merged spectra and whole whitening against numpy."""

import numpy as np
import pytest

from forestflux.llm import whitening as W


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_rank_one(d):
    """Also with equal eigenvalues, untouched directions and tiny updates."""
    r = np.random.default_rng(d)
    lam, q = np.sort(np.round(r.uniform(0, 5, d))), np.linalg.qr(r.normal(size=(d, d)))[0]
    dense = q @ np.diag(lam) @ q.T
    for step in range(30):
        v = r.normal(size=d) * 10.0 ** r.integers(-9, 3)
        if step % 3 == 0:
            v = q[:, :1].sum(1) * 2  # along an eigenvector
        dense, (lam, q) = dense + 0.7 * np.outer(v, v), W.rank_one(lam, q, v, 0.7)
        scale = max(1.0, lam[-1])
        assert np.abs(q.T @ q - np.eye(d)).max() < 1e-12
        assert np.abs(q @ np.diag(lam) @ q.T - dense).max() < 1e-11 * scale
        assert np.all(np.diff(lam) >= 0)


def test_spectra_merge():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(300, 12)) * r.uniform(0.1, 30, 12)) + 1e6
    parts = [W.Spectrum(12) for _ in range(4)]
    for i, row in enumerate(x[:299]):
        parts[i % 3].add(row)
    for p in parts[1:]:
        parts[0].merge(p)  # the last is empty
    c = x[:299] - x[:299].mean(0)
    assert parts[0].n == 299 and np.allclose(parts[0].mean, x[:299].mean(0), rtol=1e-14)
    assert np.allclose(parts[0].lam, np.linalg.eigvalsh(c.T @ c), rtol=1e-9)


def whole(spark, vectors, k=32, parts=5):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in vectors], "vec_id long, embedding array<float>, x string, id string").repartition(parts)
    return W.whiten(df, components=k).toPandas().sort_values(["vec_id", "component"])


def test_whitening(spark):
    r = np.random.default_rng(1)
    e = (r.normal(size=(200, 10)) @ r.normal(size=(10, 10))).astype(np.float32)
    odd = [(1000, None), (1001, [0.5] * 9 + [None]), (1002, [0.5] * 9 + [float("nan")]), (1003, [float("inf")] * 10), (1004, []), (1005, [0.1] * 3)]
    got = whole(spark, [(i, v.tolist()) for i, v in enumerate(e)] + odd, k=6, parts=37)
    x = np.floor(64 * e.astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1], q[:, ::-1]
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.vec_id.tolist() == np.repeat(np.arange(n), 6).tolist() and set(got.n) == {n}
    w, want = got.whitened.to_numpy().reshape(n, 6), c @ q[:, :6] / np.sqrt(values[:6])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert [int(v) for v in got.deviation[::6]] == ((n * x - s) ** 2).sum(1).tolist()
    assert np.allclose(got.explained[:6], values[:6] / values.sum(), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_few_and_equal_vectors(spark):
    assert len(whole(spark, [])) == 0
    assert len(whole(spark, [(1, None)])) == 0
    assert len(whole(spark, [(1, [1.0, 2.0])])) == 0  # no variance
    assert len(whole(spark, [(i, [1.0, 2.0]) for i in range(9)])) == 0
    got = whole(spark, [(None, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])  # one direction; null and repeated ids
    assert len(got) == 3 and set(got.component) == {1} and np.isclose((got.whitened**2).sum(), 3)
