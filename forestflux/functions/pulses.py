"""Transmitted pulses: a Gaussian fit of their width and smoothing by it. Nonlinear fits have no built-in, so Arrow batches go to numpy.

All pulses of a batch are fitted and smoothed together; a lane that has converged or failed is left alone while the others go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

START = (0.5, 25.0, 3.0)
FALLBACK_SIGMA = 3.0
#: Waveforms that are smoothed at once.
LANES = 1024


def fit_sigmas(waves: np.ndarray, start: tuple[float, float, float] = START, steps: int = 200) -> np.ndarray:
    """Widths of the Gaussians that fit the rows of a matrix above their minima (Levenberg-Marquardt), the fallback where there is none.

    Rows with missing values or without any height have none, nor rows whose fit does not end or is wider than the whole pulse.
    """
    waves = np.asarray(waves, float)
    out = np.full(len(waves), FALLBACK_SIGMA)
    if not waves.size:
        return out
    with np.errstate(invalid="ignore"):
        lanes = np.flatnonzero(np.isfinite(waves).all(1) & (np.ptp(waves, axis=1) > 0))
    y = waves[lanes] - waves[lanes].min(1, keepdims=True)
    x = np.arange(waves.shape[1], dtype=float)
    p, damping = np.tile(np.array(start), (len(lanes), 1)), np.full(len(lanes), 1e-3)

    def shape(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = x - q[:, 1:2]
        return off, np.exp(-(off**2) / (2 * q[:, 2:3] ** 2))

    with np.errstate(all="ignore"):
        r = p[:, :1] * shape(p)[1] - y
        cost = (r * r).sum(1)
        live = np.ones(len(lanes), bool)
        failed = np.zeros(len(lanes), bool)
        for _ in range(steps):
            k = np.flatnonzero(live)
            if not len(k):
                break
            off, e = shape(p[k])
            height, width = p[k, :1], p[k, 2:3]
            jac = np.stack([e, height * e * off / width**2, height * e * off**2 / width**3], 2)
            a, g = np.einsum("nij,nik->njk", jac, jac), np.einsum("nij,ni->nj", jac, r[k])
            diagonal = np.maximum(np.einsum("njj->nj", a), 1e-12) * damping[k, None]
            a = a + diagonal[:, :, None] * np.eye(3)
            solvable = np.isfinite(a).all((1, 2)) & (np.abs(np.linalg.det(np.where(np.isfinite(a), a, 0))) > 0)
            step = np.zeros((len(k), 3))
            step[solvable] = np.linalg.solve(a[solvable], -g[solvable][:, :, None])[:, :, 0]
            new = p[k] + step
            good = solvable & np.isfinite(new).all(1) & (new[:, 2] != 0)
            failed[k[~good]] = True
            live[k[~good]] = False
            k, new, step = k[good], new[good], step[good]
            after = new[:, :1] * shape(new)[1] - y[k]
            cost_after = (after * after).sum(1)
            better = cost_after < cost[k]
            b = k[better]
            p[b], r[b], cost[b] = new[better], after[better], cost_after[better]
            damping[b] /= 10
            live[b[np.abs(step[better]).max(1) < 1e-10]] = False
            worse = k[~better]
            damping[worse] *= 10
            live[worse[damping[worse] > 1e12]] = False
    found = np.abs(p[:, 2])
    out[lanes] = np.where(failed | live | ~(found <= waves.shape[1]), FALLBACK_SIGMA, found)
    return out


def smooth_all(waves: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Gaussian filters cut at four sigma, edges reflected, each row with its own width; rows with missing values stay as they are."""
    out = np.array(waves, float)
    n = out.shape[1] if out.ndim == 2 else 0
    radius = np.where(np.isfinite(sigmas) & (sigmas > 0), np.minimum(4 * sigmas + 0.5, 2**31), 0).astype(np.int64)
    todo = np.flatnonzero(np.isfinite(out).all(1) & (radius > 0)) if n else np.empty(0, int)
    todo = todo[np.argsort(radius[todo], kind="stable")]  # rows of like widths together
    for a in range(0, len(todo), LANES):
        rows = todo[a : a + LANES]
        reach = int(radius[rows].max())
        padded = np.pad(out[rows], ((0, 0), (reach, reach)), mode="symmetric")
        total, weights = np.zeros((len(rows), n)), np.zeros(len(rows))
        for k in range(-reach, reach + 1):
            w = np.where(abs(k) <= radius[rows], np.exp(-0.5 * (k / sigmas[rows]) ** 2), 0.0)
            total += w[:, None] * padded[:, reach + k : reach + k + n]
            weights += w
        out[rows] = total / weights[:, None]
    return out


def fit_sigma(wf: np.ndarray) -> float:
    """fit_sigmas of one pulse."""
    return float(fit_sigmas(np.asarray(wf, float)[None, :])[0]) if len(wf) else FALLBACK_SIGMA


def smooth(wf: np.ndarray, sigma: float) -> np.ndarray:
    """smooth_all of one waveform."""
    return smooth_all(np.asarray(wf, float)[None, :], np.array([float(sigma)]))[0] if len(wf) else np.asarray(wf, float)


def _by_length(waves: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the arrays of each length that are there; missing entries become NaN."""
    lengths = np.array([-1 if w is None else len(w) for w in waves])
    return [(at, np.array([np.asarray(waves.iloc[i], float) for i in at])) for n in np.unique(lengths[lengths >= 0]) for at in [np.flatnonzero(lengths == n)]]


def pulse_sigma(tx_wf: Column) -> Column:
    """The fitted width of an array column of pulses; NULL pulses have none."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan)
        for at, waves in _by_length(s):
            out[at] = fit_sigmas(waves)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(tx_wf)


def smoothed(rec_wf: Column, sigma: Column) -> Column:
    """An array column smoothed by the width in another, the fallback where that is NULL."""

    @F.pandas_udf("array<double>")
    def run(wf: pd.Series, s: pd.Series) -> pd.Series:
        width = s.astype(float).fillna(FALLBACK_SIGMA).to_numpy()
        out: list = [None] * len(wf)
        for at, waves in _by_length(wf):
            for i, row in zip(at, smooth_all(waves, width[at]), strict=True):
                out[i] = row
        return pd.Series(out, dtype=object)

    # arrays with missing entries stay as they are
    return F.when(F.exists(rec_wf, lambda w: w.isNull()), rec_wf.cast("array<double>")).otherwise(run(rec_wf, sigma))
