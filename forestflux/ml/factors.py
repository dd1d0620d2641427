"""Components beyond the principal ones: factor analysis and independent components, from sums that Spark takes over all rows.

Rows never leave their tasks: each iteration sends a matrix of the size of the features' square to the tasks and adds up another.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Factors:
    """loadings: a column for each factor; noise: each feature's own variance (0 for independent components); mean: what was subtracted."""

    features: list[str]
    mean: np.ndarray
    loadings: np.ndarray
    noise: np.ndarray
    scores: np.ndarray

    def columns(self) -> list[Column]:
        """Each row's scores, as expressions in the features."""
        at = [F.col(f) - F.lit(float(m)) for f, m in zip(self.features, self.mean, strict=True)]
        return [sum((a * F.lit(float(w)) for a, w in zip(at, row, strict=True)), F.lit(0.0)).alias(f"factor_{k + 1}") for k, row in enumerate(self.scores)]

    def without(self, which: list[int]) -> list[Column]:
        """The features with these factors (from 0) taken out of each row."""
        scores = self.columns()
        out = []
        for i, f in enumerate(self.features):
            gone = sum((scores[k] * F.lit(float(self.loadings[i, k])) for k in which), F.lit(0.0))
            out.append((F.col(f) - gone).alias(f))
        return out


def _summed(df: DataFrame, features: list[str], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows without missing values of what `of` gives for a matrix of rows; a part per task, added up here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
                part = of(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
    rows = rows.where(~F.greatest(*[F.isnan(f) for f in features])) if len(features) > 1 else rows.where(~F.isnan(features[0]))
    total = 0.0
    for r in rows.mapInArrow(run, "part binary").toLocalIterator():  # one small matrix a task
        total = total + pickle.loads(r.part)
    return np.asarray(total)


def moments(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of complete rows, means and covariance (divisor n), centred on the means of a first pass before multiplying."""
    first = _summed(df, features, lambda x: np.concatenate([[len(x)], x.sum(0)]))
    if first.shape == ():
        raise ValueError("no complete rows")
    n, mean = int(first[0]), first[1:] / first[0]

    def products(x: np.ndarray) -> np.ndarray:
        y = x - mean
        return y.T @ y

    return n, mean, _summed(df, features, products) / n


def factor_analysis(df: DataFrame, features: list[str], k: int, steps: int = 2000, tolerance: float = 1e-9) -> Factors:
    """Maximum-likelihood factors by expectation and maximisation on the covariance: one pass of moments, whatever the number of steps.

    Loadings are turned so that the factors fall in what they explain and each column's largest entry is positive. Scores are the
    factors' means given a row. A feature without variance loads on nothing.
    """
    _, mean, cov = moments(df, features)
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    s = cov / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(s)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-3))
    noise = np.maximum(np.diag(s) - (load**2).sum(1), 1e-3)
    before = np.inf
    for _ in range(steps):
        weighted = load / noise[:, None]
        inner = np.linalg.inv(np.eye(k) + load.T @ weighted)
        beta = inner @ weighted.T
        sb = s @ beta.T
        load = sb @ np.linalg.inv(inner + beta @ sb)
        noise = np.maximum(np.diag(s) - np.einsum("ij,ij->i", load, sb), 1e-9)
        model = load @ load.T + np.diag(noise)
        loss = np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, s))
        if before - loss < tolerance:
            break
        before = loss
    u, d, _ = np.linalg.svd(load / np.sqrt(noise)[:, None], full_matrices=False)
    load = (u * d) * np.sqrt(noise)[:, None]
    load *= np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    load, noise = load * scale[:, None], noise * scale**2
    weighted = load / noise[:, None]
    scores = np.linalg.solve(np.eye(k) + load.T @ weighted, weighted.T)
    return Factors(features, mean, load, noise, scores)


def independent_components(df: DataFrame, features: list[str], k: int, steps: int = 200, tolerance: float = 1e-6, seed: int = 0) -> Factors:
    """FastICA: whitening by the covariance, then fixed-point steps with tanh, all components at once; a pass over the rows a step."""
    n, mean, cov = moments(df, features)
    values, vectors = np.linalg.eigh(cov)
    keep = np.argsort(values)[::-1][:k]
    if values[keep[-1]] <= 1e-12 * values.max():
        raise ValueError(f"fewer than {k} directions with variance")
    white = (vectors[:, keep] / np.sqrt(values[keep])).T
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(steps):

        def step(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (x - mean) @ white.T
            g = np.tanh(z @ w.T)
            return np.concatenate([g.T @ z, (1 - g * g).sum(0)[:, None]], axis=1)

        sums = _summed(df, features, step) / n
        new = sums[:, :k] - sums[:, k:] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        moved = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1))
        w = new
        if moved < tolerance:
            break
    scores = w @ white
    load = np.linalg.pinv(scores)
    order = np.argsort(-(load**2).sum(0))
    sign = np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    load, scores = (load * sign)[:, order], (scores * sign[:, None])[order]
    return Factors(features, mean, load, np.zeros(len(features)), scores)
