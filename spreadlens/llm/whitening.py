"""Whitening of embeddings by eigenvectors refined in mixed precision (operator 13).

Entries are put on a grid of whole numbers, ``x = floor(SCALE * c) + SHIFT``, so sums are exact.  One pass gives the
covariance: every batch is centred on its own mean before multiplying, and the parts (rows, sums, centred products)
are merged pairwise.  The d x d covariance comes to the driver, where eigenvectors found in single precision are
corrected by Ogita-Aishima iterations in double precision (``refine``): each iteration is four matrix products and
doubles the right digits of separated eigenvectors.  Eigenvalues too close for that are treated as a cluster, and the
small symmetric problem within each cluster is solved on its own (``split_clusters``).

A second pass measures the covariance of the whitened vectors, a third returns them.  What is broadcast is d x 32
numbers; d, the length of a vector, is the only size the driver depends on.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as are vectors shorter
than the longest (they lack entries); an empty table gives no rows; null and repeated ids stay, repeated rows count
each time; extra columns are left out whatever their names.  A component without variance (``e`` at or under
``FLAT`` of the trace) has a null ``whitened`` and takes no part in ``identity_error``.  ``deviation`` is null if it
doesn't fit into 64 bits.  Grid values are held within ``REACH``.  Equal eigenvalues may give any basis of their
space.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bound of the grid values before the shift.
REACH = 2.0**40
#: Share of the trace under which a component counts as having no variance.
FLAT = 1e-14
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
#: Eigenvalues nearer than this part of the matrix's size are a cluster: single precision can't tell their vectors apart.
CLOSE = 1e-6
PARTS = "n bigint, sums binary, products binary"


# ------------------------------------------------------------------ moments

class Moments:
    """Rows, sums and centred products of vectors; parts of any split merge to the same moments."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray):
        self.n, self.sums, self.products = n, sums, products

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of ``x``; whole numbers are summed exactly."""
        sums = x.sum(0)
        d = (x - sums // len(x)) - (sums % len(x)) / len(x) if x.dtype == np.int64 else x - sums / len(x)
        return cls(len(x), sums, d.T @ d)

    def merge(self, o: Moments) -> Moments:
        n = self.n + o.n
        step = self.centre(o) if self.sums.dtype == np.int64 else o.sums / o.n - self.sums / self.n
        return Moments(n, self.sums + o.sums, self.products + o.products + np.outer(step, step) * (self.n / n * o.n))

    def centre(self, o: Moments) -> np.ndarray:
        """Difference of the means of two parts with whole sums, free of cancellation."""
        return (o.sums // o.n - self.sums // self.n) + (o.sums % o.n / o.n - self.sums % self.n / self.n)

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def row(self) -> pa.RecordBatch:
        return common.batch(PARTS, [self.n], [self.sums.tobytes()], [self.products.tobytes()])


def _merged(batches, kind):
    have = None
    for b in batches:
        for n, s, p in zip(*[c.to_pylist() for c in b.columns], strict=True):
            s = np.frombuffer(s, kind)
            part = Moments(n, s, np.frombuffer(p).reshape(len(s), len(s)))
            have = part if have is None else have.merge(part)
    if have is not None:
        yield have.row()


def collected(parts: DataFrame, kind: type) -> Moments | None:
    """The moments of all ``parts``, merged in two steps on Spark; one row comes to the driver."""
    wide = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    run = partial(_merged, kind=kind)
    rows = parts.repartition(wide).mapInArrow(run, PARTS).repartition(1).mapInArrow(run, PARTS).collect()
    if not rows:
        return None
    sums = np.frombuffer(rows[0]["sums"], kind)
    return Moments(rows[0]["n"], sums, np.frombuffer(rows[0]["products"]).reshape(len(sums), len(sums)))


# ------------------------------------------------------------------ vectors

def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows without null or non-finite entries."""
    v = common.take(vectors, vec_id="bigint", embedding="array<double>")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.filter(F.col("embedding").isNotNull()).filter(~bad)


def grid(b: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number vectors of the rows that have ``width`` entries."""
    ids, col = b.column(0), b.column(1)
    full = np.diff(col.offsets.to_numpy()) == width
    if not full.all():
        ids, col = ids.filter(pa.array(full)), col.filter(pa.array(full))
    c = col.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
    return ids, np.clip(np.floor(c * SCALE), -REACH, REACH).astype(np.int64) + SHIFT


def _moments(batches, width):
    have = None
    for b in batches:
        _, x = grid(b, width)
        if len(x):
            part = Moments.of(x)
            have = part if have is None else have.merge(part)
    if have is not None:
        yield have.row()


# ------------------------------------------------------------------ eigenvectors

def refine_once(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: better eigenvectors, eigenvalues, and the gap under which values count as one cluster."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding must not turn the vectors out of square
    e = np.diag(s) / (1 - np.diag(r))
    size = np.linalg.norm(a)
    gap = max(2 * (np.linalg.norm(s - np.diag(e)) + size * np.linalg.norm(r)), CLOSE * size)
    apart = e[None, :] - e[:, None]
    far = np.abs(apart) > gap
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where(far, (s + e[None, :] * r) / apart, r / 2)
    return x + x @ step, e, gap


def clusters(e: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other within ``gap``, in falling order, only where several do."""
    order = np.argsort(-e, kind="stable")
    cuts = np.flatnonzero(-np.diff(e[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def split_clusters(a: np.ndarray, x: np.ndarray, e: np.ndarray, gap: float) -> np.ndarray:
    """Turn the vectors of every cluster by the eigenvectors of ``a``, shifted by the cluster's mean, within their span."""
    x = x.copy()
    for c in clusters(e, gap):
        q, _ = np.linalg.qr(x[:, c])
        within = q.T @ (a @ q - q * e[c].mean())
        _, turn = np.linalg.eigh((within + within.T) / 2)
        x[:, c] = q @ turn
    return x


def refine(a: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix to double precision, from single precision."""
    size = float(np.abs(a).max(initial=0))
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    last = math.inf
    for _ in range(rounds):
        x, e, gap = refine_once(a, x)
        x = split_clusters(a, x, e, gap)
        s = x.T @ (a @ x)
        off = float(np.abs(s - np.diag(np.diag(s))).max(initial=0) + np.abs(np.eye(len(a)) - x.T @ x).max(initial=0))
        if off >= last / 2:
            break
        last = off
    x = x @ (1.5 * np.eye(len(a)) - 0.5 * (x.T @ x))
    x /= np.linalg.norm(x, axis=0)
    e = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-e, kind="stable")
    return e[order] * size, x[:, order]


# ------------------------------------------------------------------ on Spark

class Whitener:
    """Means, components and scales; small enough to broadcast."""

    def __init__(self, m: Moments, components: int):
        v = m.covariance()
        e, x = refine(v)
        trace = float(np.trace(v))
        k = min(components, len(e))
        self.n, self.sums, self.width = m.n, m.sums, len(e)
        live = e[:k] > FLAT * trace
        self.live = live
        self.explained = np.where(live, np.maximum(e[:k], 0) / trace, 0.0) if trace > 0 else np.zeros(k)
        self.axes = x[:, :k] / np.sqrt(np.where(live, e[:k], 1.0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows, one column a component."""
        return ((x - self.sums // self.n) - (self.sums % self.n) / self.n) @ self.axes

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of ``(n * x - sums) ** 2``, exact; null beyond 64 bits."""
        off = x - self.sums // self.n  # n * x - sums = n * off - rest, with 0 <= rest < n
        rest = self.sums % self.n
        bound = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if bound * bound * max(self.width, 1) < 1 << 63:
            d = self.n * off - rest
            return pa.array(np.einsum("ij,ij->i", d, d))
        d = off.astype(object) * self.n - rest.astype(object)
        return pa.array([s if s < 1 << 63 else None for s in ((row * row).sum() for row in d)], pa.int64())


def _whitened_moments(batches, model):
    w, have = model.value, None
    for b in batches:
        _, x = grid(b, w.width)
        if len(x):
            part = Moments.of(w(x)[:, w.live])
            have = part if have is None else have.merge(part)
    if have is not None:
        yield have.row()


def _whiten(batches, model, error):
    w = model.value
    k = len(w.live)
    for b in batches:
        ids, x = grid(b, w.width)
        if not len(x):
            continue
        rows = np.repeat(np.arange(len(x)), k)
        flat = ~np.tile(w.live, len(x))
        yield common.batch(RESULT, ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                           pa.array(np.full(len(rows), w.n)), w.deviation(x).take(pa.array(rows)), pa.array(w(x).ravel(), mask=flat),
                           pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(rows), error)))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitening of all usable ``vectors`` (vec_id, embedding); None if there are none."""
    rows = usable(vectors)
    width = rows.agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    if not width:
        return None
    m = collected(rows.mapInArrow(partial(_moments, width=width), PARTS), np.int64)
    return Whitener(m, components)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: the whitened value and how well the whole is whitened."""
    spark = vectors.sparkSession
    w = fit(vectors, components)
    if w is None:
        return spark.createDataFrame([], RESULT)
    model = spark.sparkContext.broadcast(w)
    rows = usable(vectors)
    error = None
    if w.live.any():
        m = collected(rows.mapInArrow(partial(_whitened_moments, model=model), PARTS), np.float64)
        error = float(np.abs(m.covariance() - np.eye(int(w.live.sum()))).max())
    return rows.mapInArrow(partial(_whiten, model=model, error=error), RESULT)
