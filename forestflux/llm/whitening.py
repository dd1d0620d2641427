"""Whitening of embeddings by an incremental eigendecomposition.

Every partition holds the spectrum of the scatter of what it has seen and takes each vector as a centred rank-one update: the new
eigenvalues are the roots of the secular equation, with deflation of directions that the update does not touch. Spectra of partitions
are combined, a few at a time, by one rank-one update per eigenpair of the other and one for the distance of the means. The combined
basis is refined by a distributed Rayleigh-Ritz step over all vectors, centred by their exact integer sums.

What is broadcast or comes to the driver is of the size of the square of the dimension, whatever the number of vectors.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are left out, and so are vectors shorter than the
longest; null and repeated ids are rows like any other; a table without vectors gives no rows; a direction without variance (less than
1e-12 of all) has no component, so equal vectors or a single one give no rows; other columns are ignored. Repeated eigenvalues have any
orthonormal basis of their space. The dimension is what bounds memory; the number and order of rows do not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Spectra or sums that one task combines.
FAN_IN = 16
#: Part of the trace under which a direction has no variance.
NOTHING = 1e-12
MAX_COMPONENTS = 32
#: Most steps to a root; a handful does, the rest is for bisections.
ROUNDS = 60


# ---------------------------------------------------------------- rank-one updates


def _roots(lam: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (lam - x), lam rising and apart, z2 > 0: the pole each is measured from, and its distance from that pole.

    Each root lies between two poles (the last below lam + sum z2). A rational function with these two poles is fitted to the terms
    left and right of the root again and again, and the bracket is kept, so a step that leaves it is replaced by a bisection.
    """
    k = len(lam)
    at = np.arange(k)
    gap = np.append(lam[1:] - lam[:-1], z2.sum())
    far = np.subtract.outer(lam, lam).T  # far[i, j] = lam[j] - lam[i]
    middle = 1 + (z2 / (far - gap[:, None] / 2)).sum(1)
    right = (middle < 0) & (at < k - 1)
    pole = at + right
    d = lam[None, :] - lam[pole][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    low[-1], high[-1] = (gap[-1] / 2, gap[-1]) if middle[-1] < 0 else (0.0, gap[-1] / 2)
    x = (low + high) / 2
    left = at[None, :] <= at[:, None]
    own, nxt = d[at, at], np.append(d[at[:-1], at[1:]], np.inf)
    for _ in range(ROUNDS):
        with np.errstate(all="ignore"):
            term = z2 / (d - x[:, None])
            slope = term / (d - x[:, None])
            a, b = np.where(left, term, 0).sum(1), np.where(left, 0, term).sum(1)
            da, db = np.where(left, slope, 0).sum(1), np.where(left, 0, slope).sum(1)
            f = 1 + a + b
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            u, v = own - x, nxt - x
            q = da * u * u
            s = db * v * v
            c = 1 + a - da * u + b - db * v
            # c + q / (own - y) + s / (nxt - y) = 0, solved for y - x in a form without cancellation
            bb = c * (u + v) + q + s
            cc = c * u * v + q * v + s * u
            root = np.sqrt(np.maximum(bb * bb - 4 * c * cc, 0))
            step = np.where(np.isfinite(v), np.where(bb > 0, 2 * cc / (bb + root), (bb - root) / (2 * c)), (a * a + a) / da)  # the last: Newton on 1 / a, nearly a line
            y = x + step
        new = np.where((y >= low) & (y <= high), y, (low + high) / 2)
        live = np.abs(f) > 8 * np.finfo(float).eps * (1 + np.abs(a) + np.abs(b))  # beyond rounding
        x = np.where(live, new, x)
        if not live.any():
            break
    return pole, x


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of q diag(lam) q' + rho v v', with lam rising and rho >= 0."""
    z = q.T @ v
    size = rho * float(z @ z)
    tol = 8 * np.finfo(float).eps * max(abs(lam[-1]), abs(lam[0]), size)
    if not size > tol:
        return lam, q
    z = z * np.sqrt(rho)
    q = q.copy()
    keep = np.abs(z) * np.sqrt(size) > tol
    last = -1
    touched = np.flatnonzero(keep)
    for i in touched if np.any(np.diff(lam[touched]) <= tol) else ():  # equal eigenvalues: turn the pair so that one is not touched
        if last >= 0 and lam[i] - lam[last] <= tol:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            q[:, [last, i]] = q[:, [last, i]] @ np.array([[c, s], [-s, c]])
            z[i], z[last], keep[last] = r, 0.0, False
        last = i
    at = np.flatnonzero(keep)
    poles, z2 = lam[at], z[at] ** 2
    pole, x = _roots(poles, z2)
    apart = (poles[None, :] - poles[pole][:, None]) - x[:, None]  # [i, j] = pole j - root i
    # the z for which these roots are exact: what they give is orthogonal however near they are
    with np.errstate(all="ignore"):
        others = np.subtract.outer(poles, poles)  # [l, j] = pole l - pole j
        np.fill_diagonal(others, 1.0)
        ratio = -apart / np.where(np.eye(len(at), dtype=bool), 1.0, others.T * -1)  # (root i - pole j) / (pole i - pole j)
        hat = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z[at])
        w = hat / apart
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    q[:, at] = q[:, at] @ w.T
    out = lam.copy()
    out[at] = poles[pole] + x
    order = np.argsort(out, kind="stable")
    return out[order], q[:, order]


class Spectrum:
    """Number, mean and eigenpairs of the scatter of vectors."""

    def __init__(self, d: int):
        self.n, self.mean, self.lam, self.q = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self.lam, self.q = rank_one(self.lam, self.q, x - self.mean, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + (x - self.mean) / self.n

    def merge(self, other: Spectrum) -> None:
        if not self.n or not other.n:
            if other.n:
                self.n, self.mean, self.lam, self.q = other.n, other.mean, other.lam, other.q
            return
        for value, vector in zip(other.lam, other.q.T, strict=True):
            if value > 0:
                self.lam, self.q = rank_one(self.lam, self.q, vector, float(value))
        n, apart = self.n + other.n, other.mean - self.mean
        self.lam, self.q = rank_one(self.lam, self.q, apart, self.n / n * other.n)
        self.n, self.mean = n, self.mean + apart * (other.n / n)


# ---------------------------------------------------------------- over all partitions


def _combined(found: DataFrame, add: Callable) -> object:
    """What the parts (node int, data binary) come to under add(a, b) -> a, combined FAN_IN at a time in order of their numbers."""
    found = table(found, "parts")
    nodes = int(found.agg(F.max("node")).first()[0] or 0) + 1

    def merged(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["node"])
        total = pickle.loads(rows[0]["data"])
        for row in rows[1:]:
            total = add(total, pickle.loads(row["data"]))
        return pa.table({"node": pa.array([rows[0]["node"] // FAN_IN], pa.int32()), "data": pa.array([pickle.dumps(total)], pa.binary())})

    while nodes > 1:
        before, found = found, table(found.groupBy(F.expr(f"node div {FAN_IN}")).applyInArrow(merged, "node int, data binary"), "parts")
        drop_table(before)
        nodes = -(-nodes // FAN_IN)
    rows = found.head(2)  # one row of the size of the dimension's square, or none
    drop_table(found)
    return pickle.loads(rows[0]["data"]) if rows else None


def _per_partition(vectors: DataFrame, make: Callable, take: Callable) -> DataFrame:
    """One part a partition that has vectors: make() and then take(part, matrix) -> part for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = make(), False
        for batch in batches:
            if batch.num_rows:
                part, seen = take(part, _matrix(batch.column("x"))), True
        if seen:
            yield pa.record_batch({"node": pa.array([TaskContext.get().partitionId()], pa.int32()), "data": pa.array([pickle.dumps(part)], pa.binary())})

    return vectors.select("x").mapInArrow(run, "node int, data binary")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def integer_vectors(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """rows with a whole-number vector x for each usable vector, and the dimension (0 if there is none)."""
    e = F.col(column).cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(~bad)
    d = int(good.agg(F.max(F.size(column))).first()[0] or 0)
    x = F.transform(e, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
    return good.where(F.size(column) == d).withColumn("x", x), d


def fit(vectors: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """Number, sums (whole numbers), eigenvalues (falling), eigenvectors (columns) and trace of the covariance of x."""
    sums = vectors.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, s = int(sums[0]), [int(v) for v in sums[1:]]
    whole = np.array([v // n for v in s], np.int64)  # x less this is small, and the rest of the mean is a fraction
    rest = np.array([(v % n) / n for v in s])

    def add_rows(part: Spectrum, x: np.ndarray) -> Spectrum:
        for row in x - whole:
            part.add(row.astype(float))
        return part

    def merge(a: Spectrum, b: Spectrum) -> Spectrum:
        a.merge(b)
        return a

    spectrum = _combined(_per_partition(vectors, lambda: Spectrum(d), add_rows), merge)
    basis = np.linalg.qr(spectrum.q[:, ::-1])[0]

    def add_products(part: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = ((x - whole) - rest) @ basis
        return part + y.T @ y

    ritz = _combined(_per_partition(vectors, lambda: np.zeros((d, d)), add_products), np.add) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors_ = values[::-1], basis @ turn[:, ::-1]
    return n, np.array(s, object), values, vectors_, float(np.trace(ritz))


def whiten(rows: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = MAX_COMPONENTS) -> DataFrame:
    """Per row and component: key, component, n, deviation (decimal), whitened, explained, identity_error."""
    vectors, d = integer_vectors(rows, column)
    vectors = vectors.select(F.col(key).alias("id"), "x")
    kind = dict(rows.dtypes)[key]
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    n, sums, values, basis, trace = fit(vectors, d)
    k = int(np.sum(values[: min(components, d)] > NOTHING * max(trace, 0.0)))
    whole = np.array([v // n for v in sums], np.int64)
    left = np.array([v % n for v in sums], np.int64)  # n * x - S = n * (x - whole) - left
    rest = left / n
    scaled = basis[:, :k] / np.sqrt(values[:k])

    def add_products(part: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = ((x - whole) - rest) @ scaled
        return part + w.T @ w

    if not k:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    error = float(np.abs(_combined(_per_partition(vectors, lambda: np.zeros((k, k)), add_products), np.add) / n - np.eye(k)).max())
    explained = values[:k] / trace

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x")) - whole
            w = (x - rest) @ scaled
            dev = [sum(c * c for c in row) for row in (n * x.astype(object) - left)]
            m = len(w)
            at = np.repeat(np.arange(m), k)
            yield pa.record_batch(
                {
                    "id": batch.column("id").take(pa.array(at)),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, n),
                    "deviation": pa.array(dev, pa.decimal128(38, 0)).take(pa.array(at)),
                    "whitened": w.ravel(),
                    "explained": np.tile(explained, m),
                    "identity_error": np.full(m * k, error),
                }
            )

    return vectors.mapInArrow(out, schema).withColumnRenamed("id", key)
