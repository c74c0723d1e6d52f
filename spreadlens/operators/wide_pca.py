"""Principal components of wide vectors without a d x d matrix.

A seeded random block of directions is turned towards the leading axes by passes over the rows: each sums x (x' Q) around the
mean, a d x (k + ``EXTRA``) matrix, in Arrow partial sums (``partials.summed``), and a small QR follows on the driver.  A pass
also gives the block's own covariance, so the passes end when the wanted variances stand still.  What a task or the driver
holds grows with d, not with its square; 6,720 columns take 4 MB a pass for ten components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .partials import summed

EXTRA, PASSES, STILL = 10, 60, 1e-12
STORED = "place int, mean double, scale double, axis array<double>"


def _vectors(col: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(col.offsets.to_numpy())
    if col.null_count or (sizes != width).any():
        raise ValueError(f"a vector has no {width} entries")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)


class Components:
    """Mean, scale, axes (d x k), variance along each axis and the total variance."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, axes: np.ndarray, variance: np.ndarray, total: float, rows: int):
        self.mean, self.scale, self.axes = mean, scale, axes
        self.variance, self.total, self.rows = variance, total, rows

    def table(self, spark: SparkSession) -> DataFrame:
        """(component, explained, cumulative): shares of the total variance."""
        share = self.variance / self.total if self.total > 0 else np.zeros(len(self.variance))
        return spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(share, np.cumsum(share), strict=True))],
                                     "component int, explained double, cumulative double")

    def project(self, df: DataFrame, vec_col: str, whiten: bool = False, out: str = "z") -> DataFrame:
        """``df`` with an array of its vectors' components (of unit variance with ``whiten``) in place of the vectors."""
        turn = self.axes / self.scale[:, None]
        if whiten:
            sd = np.sqrt(np.maximum(self.variance, 0))
            turn = turn * np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
        sent = df.sparkSession.sparkContext.broadcast((self.mean, turn))
        others = [c for c in df.columns if c != vec_col]

        def run(batches):
            mean, axes = sent.value
            for b in batches:
                z = (_vectors(b.column(len(others)), len(mean)) - mean) @ axes
                offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=[*others, out])

        schema = T.StructType([df.schema[c] for c in others] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
        return df.select(*others, F.col(vec_col).cast("array<double>")).mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a Parquet table: one row a place, and one (place -1) of the variances."""
        rows = [(i, float(m), float(s), a.tolist()) for i, (m, s, a) in enumerate(zip(self.mean, self.scale, self.axes, strict=True))]
        spark.createDataFrame([*rows, (-1, self.total, float(self.rows), self.variance.tolist())], STORED).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Components:
        rows = sorted(tuple(r) for r in spark.read.parquet(path).collect())  # one row a place
        (_, total, n, variance), places = rows[0], rows[1:]
        return cls(np.array([r[1] for r in places]), np.array([r[2] for r in places]), np.array([r[3] for r in places]).reshape(len(places), -1),
                   np.array(variance), total, int(n))


def fit(df: DataFrame, vec_col: str, k: int, scaled: bool = False, seed: int = 7) -> Components | None:
    """The first ``k`` principal components of an array column; with ``scaled`` of entries of unit deviation (constant: 0).

    Null vectors are left out; None without rows.  Variances have divisor n - 1.  The vectors are written to the checkpoint folder once.
    """
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v")).checkpoint()
    width = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if not width:
        return None

    def moments(b):
        x = _vectors(b.column(0), width)
        return np.concatenate([[len(x)], x.sum(0)])

    first = summed(rows, moments)
    n, mean = int(first[0]), first[1:] / first[0]

    def squares(b):
        x = _vectors(b.column(0), width) - mean
        return np.einsum("ij,ij->j", x, x)

    var = summed(rows, squares) / max(n - 1, 1)
    var[var < 1e-18 * max(var.max(initial=0), 1e-300)] = 0
    scale = np.where(var > 0, np.sqrt(np.where(var > 0, var, 1)), 1.0) if scaled else np.ones(width)
    total = float((var / scale**2).sum())
    k = min(k, width)
    block = min(width, k + EXTRA)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))
    before = np.full(k, np.inf)
    for _ in range(PASSES):
        def turned(b):
            x = (_vectors(b.column(0), width) - mean) / scale
            return (x.T @ (x @ q)).ravel()

        # C q, of which q' C q is the block's own covariance
        ahead = summed(rows, turned).reshape(width, block) / max(n - 1, 1)
        e, u = np.linalg.eigh((q.T @ ahead + ahead.T @ q) / 2)
        order = np.argsort(-e, kind="stable")
        now, axes = np.maximum(e[order], 0)[:k], q @ u[:, order[:k]]
        if block == width or np.abs(now - before).max() <= STILL * max(now.max(initial=0), 1e-300):
            break
        before = now
        q, _ = np.linalg.qr(ahead)
    return Components(mean, scale, axes, now, total, n)
