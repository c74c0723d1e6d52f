"""Row matrices and sums of numpy arrays over all partitions, shared by the batched solvers.

A row matrix has one row an example: id, y (0/1), x (array of doubles) and the values of the columns that split rows
into training and held-out ones.  A kernel turns the batches of a partition into arrays of doubles; ``summed`` adds those of
all partitions in two steps on Spark, and only the total comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = "total binary"


@dataclass(frozen=True)
class Split:
    """Which rows train a model: those whose ``column`` is none of ``values``, or with ``inside`` those where it is one.

    With a ``scope`` (column, value) only rows that have it train or are held out at all.
    """

    column: str
    values: str | tuple[str, ...]
    inside: bool = False
    scope: tuple[str, str] | None = None


#: Every row trains.
EVERY = Split("", ())


def matrix(df: DataFrame, id_col: str, label: str, features: list[str], splits: list[str] = ()) -> DataFrame:
    """(id, y, x, splits) of the rows with a label, written to the checkpoint folder once; missing features are NaN."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    s = F.array(*[F.col(c).cast("string") for c in splits]) if splits else F.array().cast("array<string>")
    rows = df.where(F.col(label).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("double").alias("y"), x.alias("x"), s.alias("splits"))
    return rows.checkpoint()


class Rows:
    """A batch of a row matrix in numpy."""

    def __init__(self, b: pa.RecordBatch, width: int, columns: list[str]):
        self.ids, self.y = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        self.x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), width)
        at = {c: i for i, c in enumerate(columns)}
        self.values = {c: pc.list_element(b.column(3), i) for c, i in at.items()}

    def __len__(self) -> int:
        return len(self.y)

    def has(self, column: str, values: str | tuple[str, ...]) -> np.ndarray:
        """Which rows have one of ``values``; a null is none."""
        wanted = pa.array([values] if isinstance(values, str) else list(values), pa.string())
        return pc.is_in(self.values[column], wanted, skip_nulls=True).to_numpy(zero_copy_only=False)

    def scoped(self, split: Split) -> np.ndarray:
        """Which rows ``split`` is about."""
        return np.ones(len(self), bool) if split.scope is None else self.has(*split.scope)

    def trains(self, split: Split) -> np.ndarray:
        """Which rows train under ``split``."""
        if not split.column:
            return self.scoped(split)
        same = self.has(split.column, split.values)
        return self.scoped(split) & (same if split.inside else ~same)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column(0).to_pylist():
            v = np.frombuffer(raw)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield total_row(total)


def total_row(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, np.float64).tobytes()], pa.binary())], names=["total"])


def summed(rows: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``kernel(batch)`` over all batches of ``rows``; None without rows."""
    def run(batches):
        total = None
        for b in batches:
            if len(b):
                v = kernel(b)
                total = v if total is None else total + v
        if total is not None:
            yield total_row(total)

    parts = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(run, SUMS)
    if parts > 1:
        found = found.repartition(math.isqrt(parts)).mapInArrow(_added, SUMS).repartition(1).mapInArrow(_added, SUMS)
    got = found.collect()  # one row
    return np.frombuffer(got[0]["total"]) if got else None
