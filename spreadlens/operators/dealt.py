"""AUC of a linear model's scores when one feature's values are dealt anew (M23), in numpy over Arrow batches.

The test rows are written once with their draws.  For each repeat they are dealt into slices by their draw, and a task sorts its
slices and gives every row the values of the next one; the last row of a slice takes those of the first row of the next slice, which
a small table knows.  Scores leave the task sorted, by key (repeat, feature) and slice of the score, as values with counts of both classes;
a slice's share of the AUC follows from its own scores, and the rest from the class counts of the slices below it.  The AUC is exact, with
ties; rows are shuffled once a repeat, scores once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import MD5_SPAN, md5_int
from .ranking import MAX_SLICES, SAMPLE_PER_SLICE
from .tiled_graph import written

#: Rows of a slice of draws, and scores of a slice of a key.
SLICE_ROWS, SLICE_SCORES = 100_000, 200_000
SCORED = "key int, slice int, score binary, ones binary, all binary"
SHARES = "key int, slice int, n1 double, n0 double, pairs double"


class Scorer:
    """A logistic model on standardised features, step by step as Spark ML scores it."""

    def __init__(self, mean: list, sd: list, coef: np.ndarray, intercept: float):
        self.mean = np.array([np.nan if m is None else m for m in mean], float)
        self.sd = np.array([0.0 if s is None else s for s in sd], float)
        self.coef, self.intercept = np.asarray(coef, float), float(intercept)

    def z(self, x: np.ndarray) -> np.ndarray:
        flat = self.sd == 0
        return np.where(flat, 0.0, (x - self.mean) / np.where(flat, 1.0, self.sd))

    def scores(self, z: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(z))
        for f, w in enumerate(self.coef):
            margin = margin + z[:, f] * w
        with np.errstate(over="ignore"):
            p = 1.0 - 1.0 / (1.0 + np.exp(margin + self.intercept))
        return np.where(np.isnan(p), 2.0, p)  # all NaN are one score, above the others


def counted(score: np.ndarray, ones: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct scores with their counts of class 1 and of all rows."""
    order = np.argsort(score, kind="stable")
    score, ones, every = score[order], ones[order], every[order]
    if not len(score):
        return score, ones, every
    first = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    return score[first], np.add.reduceat(ones, first), np.add.reduceat(every, first)


def matrix_of(columns: list[pa.ChunkedArray]) -> np.ndarray:
    return np.stack([c.cast(pa.float64()).fill_null(np.nan).to_numpy() for c in columns], 1)


def dealt_auc(test: DataFrame, id_col: str, at_col: str, label: str, features: list[str], scorer: Scorer, repeats: int, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """(feature, repeat, auc) of the dealt rows, and the AUC of the rows as they are; None without rows.

    Rows of one id come by class and then by ``at_col``, a number of each row.
    """
    spark, xs = test.sparkSession, [f"x{i}" for i in range(len(features))]
    test = written(test.select(F.col(id_col).alias("id"), F.col(at_col).alias("at"), F.col(label).cast("int").alias("y"),
                               *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs, strict=True)],
                               *[md5_int(F.lit(seed), F.lit(r), F.col(id_col)).cast("int").alias(f"u{r}") for r in range(repeats)]))
    n = test.count()
    if not n:
        return None
    slices, cuts = (min(MAX_SLICES, math.ceil(n / size)) for size in (SLICE_ROWS, SLICE_SCORES))
    draws = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(f"u{r}").alias("u")) for r in range(repeats)])).alias("d")
    dealt = test.select("id", "at", "y", *xs, draws).select("d.repeat", (F.col("d.u") * F.lit(slices).cast("bigint") / F.lit(MD5_SPAN)).cast("int").alias("slice"),
                                                            "d.u", "id", "at", "y", *xs)

    # one row a slice: numbers first, since the least of texts takes a sort
    least = dealt.groupBy("repeat", "slice").agg(F.min("u").alias("u"))
    least = dealt.join(F.broadcast(least), ["repeat", "slice", "u"]).groupBy("repeat", "slice").agg(F.min(F.struct("u", "id", "y", "at", *xs)).alias("m"))
    firsts = sorted((r["repeat"], r["slice"], [np.nan if r["m"][x] is None else r["m"][x] for x in xs]) for r in least.collect())
    after: dict[tuple[int, int], np.ndarray] = {}
    for r in range(repeats):
        own = [(s, x) for of, s, x in firsts if of == r]
        after |= {(r, s): np.array(own[(i + 1) % len(own)][1], float) for i, (s, _) in enumerate(own)}

    # a bounded sample of the scores as they are cuts all keys' scores
    sample = test.select(*xs).sample(min(1.0, SAMPLE_PER_SLICE * cuts / n), 7).toArrow() if cuts > 1 else None
    bounds = np.zeros(0)
    if sample is not None and len(sample):
        drawn = np.sort(scorer.scores(scorer.z(matrix_of(sample.columns))))
        bounds = np.unique(drawn[len(drawn) * np.arange(1, cuts) // cuts])
    keys = len(features)

    def records(key, score, y):
        score, ones, every = counted(score, y, np.ones(len(y), np.uint32))
        ends = np.append(np.searchsorted(score, bounds, side="right"), len(score))
        lo = np.append(0, ends[:-1])
        some = np.flatnonzero(ends > lo)
        arrays = [pa.array([v[lo[s]:ends[s]].astype(k).tobytes() for s in some], pa.binary()) for v, k in ((score, np.float64), (ones, np.uint32), (every, np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key, np.int32)), pa.array(some.astype(np.int32)), *arrays], names=["key", "slice", "score", "ones", "all"])

    def scored(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("repeat", "slice", "u", "id", "y", "at")], null_placement="at_start"))
        repeat, place, y = (t[c].to_numpy() for c in ("repeat", "slice", "y"))
        x = matrix_of([t[c] for c in xs])
        following = np.empty_like(x)
        following[:-1] = x[1:]
        last = np.flatnonzero(np.append((repeat[1:] != repeat[:-1]) | (place[1:] != place[:-1]), True))
        following[last] = [after[int(repeat[i]), int(place[i])] for i in last]
        z, new, y = scorer.z(x), scorer.z(following), y.astype(np.uint32)
        for r in np.unique(repeat):
            own = np.flatnonzero(repeat == r)
            if r == 0:
                yield records(-1, scorer.scores(z[own]), y[own])
            for f in range(keys):
                turned = z[own]
                turned[:, f] = new[own, f]
                yield records(int(r) * keys + f, scorer.scores(turned), y[own])

    def shared(now, score, ones, every):
        _, ones, every = counted(*(np.concatenate([np.frombuffer(b, k) for b in v]) for v, k in ((score, np.float64), (ones, np.uint32), (every, np.uint32))))
        n1 = ones.astype(np.float64)
        n0 = every - n1
        pairs = (n1 * (np.cumsum(n0) - 0.5 * n0)).sum()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, n1.sum(), n0.sum(), pairs), (pa.int32(), pa.int32(), *[pa.float64()] * 3), strict=True)],
                                          names=["key", "slice", "n1", "n0", "pairs"])

    def counts(batches):
        now, held = None, ([], [], [])
        for b in batches:
            for key, s, *raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (key, s) != now:
                    if now is not None:
                        yield shared(now, *held)
                    now, held = (key, s), ([], [], [])
                for to, v in zip(held, raw, strict=True):
                    to.append(v)
        if now is not None:
            yield shared(now, *held)

    parts = max(1, min(slices * repeats, MAX_SLICES))
    scores = dealt.repartition(parts, "repeat", "slice").mapInArrow(scored, SCORED)
    wide = max(1, min((len(bounds) + 1) * (keys * repeats + 1), MAX_SLICES))
    parts = scores.repartition(wide, "key", "slice").sortWithinPartitions("key", "slice").mapInArrow(counts, SHARES).checkpoint()  # a row a slice of a key
    below = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    lower = parts.withColumn("below", F.coalesce(F.sum("n0").over(below), F.lit(0.0)))
    n1, n0 = F.sum("n1"), F.sum("n0")
    auc = lower.groupBy("key").agg(F.when((n1 > 0) & (n0 > 0), F.sum(F.col("pairs") + F.col("n1") * F.col("below")) / (n1 * n0)).alias("auc"))
    auc = auc.checkpoint()
    names = F.array(*[F.lit(f) for f in features])
    per = auc.where("key >= 0").select(F.get(names, (F.col("key") % keys).cast("int")).alias("feature"), (F.col("key") / keys).cast("int").alias("repeat"), "auc")
    return per, auc.where("key = -1").select(F.col("auc").alias("base"))
