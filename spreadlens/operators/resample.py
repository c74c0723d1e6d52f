"""Resampling tests with md5 draws (H2, H4, H5).

Replicates are a column, not a loop.  Draws come from ``md5(seed|rep|…)``, so a
task retry redraws the same numbers.  Every row draws once for each replicate
where it is read, and only sums by replicate are shuffled: a permutation by the
draw's bin, a bootstrap by the class.  The replicate count multiplies the
work, so callers choose ``B`` (the reference: 10,000 permutations, 2,000
bootstraps) with the cluster in mind.
"""

from __future__ import annotations

import math
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import MD5_SPAN, md5_int, md5_uniform
from .ranking import prefix_sums
from .rollup import exact_quantiles

#: Bins of a draw; only the rows of one bin a replicate are ranked.
DRAW_BINS = 4096
TIE_EPS = 1e-12
#: Ids whose draws are in memory at once, and the sums of a bootstrap by replicate.
IDS, SUMS = 256, ["_s1", "_w1", "_s0", "_w0"]


def permutation_test(df: DataFrame, keys: list[str], id_col: str, value: str, label: str,
                     n_perm: int = 10_000, seed: int = 42) -> DataFrame:
    """H2: one-sided permutation test of mean(value|1) − mean(value|0).

    In replicate r the labels are reassigned by giving label 1 to the
    ``n1`` rows with the smallest ``md5(seed|r|id)`` (ties by id), which is
    an exact uniform permutation of the label vector.  Returns ``delta``,
    ``p_value = (#{δ* ≥ δ} + 1)/(B + 1)`` and the null mean/std.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(id_col).cast("string").alias("_id"), F.col(value).cast("double").alias("_v"), F.col(label).cast("int").alias("_y"))
    obs = base.groupBy(*keys).agg(F.sum("_y").alias("_n1"), F.sum(1 - F.col("_y")).alias("_n0"), F.sum("_v").alias("_total"),
                                  F.avg(F.when(F.col("_y") == 1, F.col("_v"))).alias("_m1"),
                                  F.avg(F.when(F.col("_y") == 0, F.col("_v"))).alias("_m0"))
    draws = (base.select(*keys, "_id", "_v", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("rep"))
             .withColumn("_u", md5_int(F.lit(seed), F.col("rep"), F.col("_id")))
             .withColumn("_bin", F.floor(F.col("_u") / (MD5_SPAN // DRAW_BINS)).cast("int")))

    def with_obs(x: DataFrame) -> DataFrame:
        return x.join(obs, keys) if keys else x.crossJoin(F.broadcast(obs))  # one row without keys

    bins = draws.groupBy(*keys, "rep", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"))
    w = Window.partitionBy(*keys, "rep").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    at = with_obs(bins.withColumns({"_c_below": F.coalesce(F.sum("_c").over(w), F.lit(0)), "_s_below": F.coalesce(F.sum("_s").over(w), F.lit(0.0))}))
    # the bin in which the n1-th smallest draw lies; below it all rows get label 1
    edge = at.where((F.col("_c_below") < F.col("_n1")) & (F.col("_n1") <= F.col("_c_below") + F.col("_c"))).select(
        *keys, "rep", "_bin", (F.col("_n1") - F.col("_c_below")).alias("_left"), "_s_below")
    order = Window.partitionBy(*keys, "rep").orderBy("_u", "_id")
    inside = (draws.join(edge, [*keys, "rep", "_bin"]).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= F.col("_left"))
              .groupBy(*keys, "rep").agg((F.sum("_v") + F.max("_s_below")).alias("_s1")))
    null = with_obs(inside).select(*keys, "_m1", "_m0", (
        F.try_divide(F.col("_s1"), F.col("_n1")) - F.try_divide(F.col("_total") - F.col("_s1"), F.col("_n0"))).alias("delta"))
    found = null.withColumn("_obs", F.col("_m1") - F.col("_m0")).groupBy(*keys).agg(
        # replicates that reproduce the observed split tie with it up to rounding
        ((F.sum((F.col("delta") >= F.col("_obs") - TIE_EPS).cast("int")) + 1) / (n_perm + 1)).alias("p_value"),
        F.avg("delta").alias("null_mean"), F.stddev_pop("delta").alias("null_std"))
    # a group with one class stays, without a test
    seen = obs.select(*keys, (F.col("_m1") - F.col("_m0")).alias("delta"))
    return seen.join(found, keys, "left") if keys else seen.crossJoin(F.broadcast(found))


def poisson_one(u: Column, top: int = 12) -> Column:
    """A Poisson(1) count from a uniform draw (the tail beyond ``top`` has a mass under 1e-9)."""
    total, out = 0.0, F.lit(0)
    for k in range(top):
        total += math.exp(-1) / math.factorial(k)
        out = out + (u >= total).cast("int")
    return out


def _poisson_sums(batches, keys: int, n_boot: int, seed: int):
    """For rows (keys, id, value, class): each group's weighted sums and weights of both classes by replicate, a few ids at a time."""
    ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    heads = [f"{seed}|{r}".encode() for r in range(1, n_boot + 1)]
    kinds = None

    def counts(ids: list) -> np.ndarray:
        """``poisson_one(md5_uniform(seed, rep, id))`` for ids x replicates; like ``concat_ws``, a null id adds nothing."""
        tails = [b"" if i is None else b"|" + i.encode() for i in ids]
        first = np.frombuffer(b"".join([md5(h + t).digest()[:4] for t in tails for h in heads]), ">u4")
        return np.searchsorted(ends, (first >> 4) / float(MD5_SPAN), side="right").reshape(len(ids), n_boot).astype(float)

    def rows(held: dict) -> pa.RecordBatch:
        columns = [pa.array([g[k] for g in held], kinds[k]) for k in range(keys)]
        columns += [pa.array([list(s[j]) for s in held.values()], pa.list_(pa.float64())) for j in range(len(SUMS))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for b in batches:
        kinds, names = [c.type for c in b.columns[:keys]], [*b.schema.names[:keys], *SUMS]
        own = list(zip(*[c.to_pylist() for c in b.columns[:keys]], strict=True)) if keys else [()] * len(b)
        of = {g: i for i, g in enumerate(dict.fromkeys(own))}
        group = np.array([of[g] for g in own], int)
        coded = pc.dictionary_encode(b.column(keys), null_encoding="encode")
        place, ids = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        value, positive = b.column(keys + 1).to_numpy(), b.column(keys + 2).to_numpy() == 1
        names_of, held = list(of), {}
        for lo in range(0, len(ids), IDS):
            at = np.flatnonzero((place >= lo) & (place < lo + IDS))
            at = at[np.argsort(group[at], kind="stable")]
            drawn = counts(ids[lo:lo + IDS])
            for rows_of in np.split(at, np.flatnonzero(np.diff(group[at])) + 1):
                g = names_of[group[rows_of[0]]]
                total = held.setdefault(g, np.zeros((len(SUMS), n_boot)))
                for j, side in ((0, positive[rows_of]), (2, ~positive[rows_of])):
                    r = rows_of[side]
                    found, back = np.unique(place[r] - lo, return_inverse=True)
                    total[j] += np.bincount(back, value[r], len(found)) @ drawn[found]
                    total[j + 1] += np.bincount(back, minlength=len(found)) @ drawn[found]
                if len(held) >= 64:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)


def bootstrap_mean_diff(df: DataFrame, keys: list[str], id_col: str, value: str, label: str,
                        n_boot: int = 1000, seed: int = 137) -> DataFrame:
    """H4/H5: bootstrap of mean(value|1) − mean(value|0), with class sizes.

    In replicate b a row counts Poisson(1) times, drawn from
    ``md5(seed|b|id)``: the limit of drawing n rows with replacement, which
    needs no row index and no join.  Replicates without one of the classes
    are left out (``n_replicates`` says how many stay).  Returns ``delta_obs,
    ci_low, ci_high`` (exact 2.5/97.5 percentiles) and ``p_value = mean(δ* ≤ 0)``; a
    group with one class stays, with its sizes and nulls.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(id_col).cast("string").alias("_id"), F.col(value).cast("double").alias("_v"),
        F.col(label).cast("int").alias("_y"))
    one = F.col("_y") == 1
    # the draws are the work, whatever the rows weigh: every core gets its share of the ids, and an id draws once for all of its rows
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    kinds = T.StructType([base.schema[k] for k in keys] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in SUMS])
    added = base.repartition(parts, "_id").sortWithinPartitions("_id").mapInArrow(partial(_poisson_sums, keys=len(keys), n_boot=n_boot, seed=seed), kinds)
    sums = (added.select(*keys, F.posexplode(F.arrays_zip(*SUMS)).alias("rep", "_z")).groupBy(*keys, "rep")
            .agg(*[F.sum(F.col("_z")[c]).alias(c[1:]) for c in SUMS]))
    per_rep = sums.select(*keys, (F.try_divide("s1", "w1") - F.try_divide("s0", "w0")).alias("delta")).where(F.col("delta").isNotNull())
    obs = base.groupBy(*keys).agg(
        (F.avg(F.when(one, F.col("_v"))) - F.avg(F.when(~one, F.col("_v")))).alias("delta_obs"),
        F.sum(one.cast("int")).alias("n_pos"), F.sum((~one).cast("int")).alias("n_neg"))
    counts = per_rep.groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("_c"))
    q = exact_quantiles(counts, keys, "delta", "_c", [0.025, 0.975])
    ci = q.groupBy(*keys).agg(F.max(F.when(F.col("p") == 0.025, F.col("q"))).alias("ci_low"),
                              F.max(F.when(F.col("p") == 0.975, F.col("q"))).alias("ci_high"))
    pv = per_rep.groupBy(*keys).agg(F.avg((F.col("delta") <= 0).cast("double")).alias("p_value"),
                                    F.count(F.lit(1)).alias("n_replicates"))
    if keys:
        return obs.join(ci, keys, "left").join(pv, keys, "left").fillna(0, ["n_replicates"])
    return obs.crossJoin(F.broadcast(ci)).crossJoin(F.broadcast(pv))  # one row each


def _curves(by: DataFrame, keys: list[str]) -> DataFrame:
    """Running class counts by score within each replicate, and the replicate's totals."""
    cum = prefix_sums(by, keys, ["_s"], {"cum1": F.col("c1"), "cum0": F.col("c0")})
    return cum.join(cum.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")), keys)


def _weighted_counts(df: DataFrame, keys: list[str], id_col: str, score: str, label: str, n_boot: int, seed: int) -> DataFrame:
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(id_col).cast("string").alias("_id"), F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y"))
    draws = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep")).withColumn(
        "_w", poisson_one(md5_uniform(F.lit(seed), F.col("rep"), F.col("_id"))))
    return draws.groupBy(*keys, "rep", "_s").agg(F.sum(F.col("_w") * F.col("_y")).alias("c1"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("c0"))


def bootstrap_auc(df: DataFrame, keys: list[str], id_col: str, score: str, label: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Mean and exact 2.5/97.5 percentiles of the AUC of a score over Poisson bootstrap replicates."""
    keys = list(keys)
    curve = _curves(_weighted_counts(df, keys, id_col, score, label, n_boot, seed), [*keys, "rep"]).where("n1 > 0 and n0 > 0")
    per = curve.groupBy(*keys, "rep").agg((F.sum(F.col("c1") * (F.col("cum0") - 0.5 * F.col("c0"))) / (F.max("n1") * F.max("n0"))).alias("auc"))
    q = exact_quantiles(per.groupBy(*keys, "auc").agg(F.count(F.lit(1)).alias("_c")), keys, "auc", "_c", [0.025, 0.975])
    ends = q.groupBy(*keys).agg(F.max(F.when(F.col("p") == 0.025, F.col("q"))).alias("auc_low"), F.max(F.when(F.col("p") == 0.975, F.col("q"))).alias("auc_high"))
    mean = per.groupBy(*keys).agg(F.avg("auc").alias("auc_mean"))
    return mean.join(ends, keys) if keys else mean.crossJoin(F.broadcast(ends))


def bootstrap_roc_band(df: DataFrame, keys: list[str], id_col: str, score: str, label: str, n_boot: int = 200,
                       points: int = 200, seed: int = 137) -> DataFrame:
    """2.5 and 97.5 percentiles of the bootstrapped ROC at ``points`` false-positive rates.

    Replicates weigh rows with Poisson(1) counts; weighted counts by score
    give each replicate's curve; its TPR at a grid point is that of the lowest
    threshold whose FPR does not exceed it.  The ends are fixed at 0 and 1.
    """
    keys = list(keys)
    by = _weighted_counts(df, keys, id_col, score, label, n_boot, seed)
    curve = _curves(by, [*keys, "rep"]).where("n1 > 0 and n0 > 0").withColumns(
        {"tp": F.col("n1") - F.col("cum1") + F.col("c1"), "fp": F.col("n0") - F.col("cum0") + F.col("c0")})
    # each curve point reaches from its own grid cell on; a running maximum fills the cells between
    cell = F.ceil(F.col("fp") / F.col("n0") * (points - 1) - 1e-9).cast("int")
    best = curve.groupBy(*keys, "rep", cell.alias("g")).agg(F.max(F.col("tp") / F.col("n1")).alias("tpr"))
    reps = curve.select(*keys, "rep").distinct()
    grid = reps.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    up = Window.partitionBy(*keys, "rep").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tpr = F.when(F.col("g") == 0, 0.0).when(F.col("g") == points - 1, 1.0).otherwise(F.coalesce(F.max("tpr").over(up), F.lit(0.0)))
    filled = grid.join(best, [*keys, "rep", "g"], "left").withColumn("tpr", tpr)
    counts = filled.groupBy(*keys, "g", F.col("tpr")).agg(F.count(F.lit(1)).alias("_c"))
    q = exact_quantiles(counts, [*keys, "g"], "tpr", "_c", [0.025, 0.975])
    return q.groupBy(*keys, "g").agg(F.max(F.when(F.col("p") == 0.025, F.col("q"))).alias("tpr_low"),
                                     F.max(F.when(F.col("p") == 0.975, F.col("q"))).alias("tpr_high")).select(
        *keys, (F.col("g") / F.lit(points - 1)).alias("fpr"), "tpr_low", "tpr_high")
