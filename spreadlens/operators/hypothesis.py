"""Two-sample tests and effect sizes as grouped jobs.

All tests compare label 1 against label 0 within each group of ``keys``
(dataset, feature, layer/head, …) in one plan — there is no Python loop
over groups.  Ordering work goes through ``ranking.prefix_sums`` on value
counts, so a group that holds most of the rows is still split over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import ks_pvalue, normal_sf, stars
from .metrics import score_counts
from .ranking import average_ranks, prefix_sums


def ks_tests(long: DataFrame, keys: list[str], value: str = "value", label: str = "label",
             alpha: float = 0.05, n_tests: int | None = None) -> DataFrame:
    """H1: two-sample KS per group, label 1 vs 0.

    ``D = max_v |F1(v) − F0(v)|`` from running class counts; groups with
    fewer than 2 rows in a class are skipped; the p-value is the asymptotic
    Kolmogorov series; ``significant`` uses Bonferroni over ``n_tests``
    (default: the number of distinct ``feature`` values, else 1).
    """
    keys = list(keys)
    counts = score_counts(long, keys, value, label)
    cum = prefix_sums(counts, keys, ["score"], {"cum1": F.col("c1"), "cum0": F.col("c0")})
    tot = counts.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))
    x = cum.join(tot.where((F.col("n1") >= 2) & (F.col("n0") >= 2)), keys)
    d = x.groupBy(*keys, "n1", "n0").agg(
        F.max(F.abs(F.col("cum1") / F.col("n1") - F.col("cum0") / F.col("n0"))).alias("ks_stat"))
    m = n_tests or 1
    p = ks_pvalue("ks_stat", "n1", "n0")
    return d.select(*keys, "n1", "n0", "ks_stat", p.alias("p_value")).select(
        "*", stars("p_value").alias("sig"), (F.col("p_value") < alpha / m).alias("significant"))


def mann_whitney(long: DataFrame, keys: list[str], value: str = "value", label: str = "label") -> DataFrame:
    """H6: two-sided Mann–Whitney U (tie-corrected normal approximation with
    continuity correction), label 1 as the first sample.  A group with one
    class stays, without a statistic."""
    keys = list(keys)
    counts = score_counts(long, keys, value, label).withColumn("c", F.col("c1") + F.col("c0"))
    ranked = average_ranks(counts, keys, "score", "c")
    agg = ranked.groupBy(*keys).agg(
        F.sum(F.col("c1") * F.col("avg_rank")).alias("r1"),
        F.sum("c1").alias("n1"), F.sum("c0").alias("n0"),
        F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("tie"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    u = F.greatest(u1, n1 * n0 - u1)
    sigma = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1))))
    z = F.try_divide(u - n1 * n0 / 2.0 - 0.5, sigma)
    p = F.least(F.lit(1.0), 2.0 * normal_sf(z))
    both = (n1 > 0) & (n0 > 0)
    return agg.select(
        *keys, "n1", "n0", F.when(both, u1).alias("u_stat"), F.when(both, z).alias("z"),
        F.when(both & (sigma > 0), p).alias("p_value")).withColumn("significant", F.col("p_value") < 0.05)


def significant_share(results: DataFrame, keys: list[str]) -> DataFrame:
    """H7: significant count, finite total and share over all cells (NaN counts as not significant)."""
    sig = F.coalesce(F.col("significant"), F.lit(False)).cast("int")
    return results.groupBy(*keys).agg(
        F.sum(sig).alias("n_significant"),
        F.sum(F.col("p_value").isNotNull().cast("int")).alias("n_finite"),
        F.count(F.lit(1)).alias("n_cells"),
        (F.sum(sig) / F.count(F.lit(1))).alias("share_significant"))


def cohens_d(long: DataFrame, keys: list[str], value: str = "value", label: str = "label") -> DataFrame:
    """H8: (mean1 − mean0) / pooled sample SD of the finite values; null if a class has < 2 of them; 0 if SD is 0."""
    v = F.col(value).cast("double")
    y = F.col(label)
    g = long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).groupBy(*keys).agg(
        F.sum((y == 1).cast("int")).alias("n1"), F.sum((y == 0).cast("int")).alias("n0"),
        F.avg(F.when(y == 1, v)).alias("m1"), F.avg(F.when(y == 0, v)).alias("m0"),
        F.var_samp(F.when(y == 1, v)).alias("v1"), F.var_samp(F.when(y == 0, v)).alias("v0"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"),
                                 F.col("n1") + F.col("n0") - 2))
    d = F.when((F.col("n1") < 2) | (F.col("n0") < 2), F.lit(None).cast("double")) \
        .when(pooled == 0, F.lit(0.0)).otherwise((F.col("m1") - F.col("m0")) / pooled)
    return g.select(*keys, "n1", "n0", "m1", "m0", d.alias("cohens_d"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 40, by: str | None = None) -> DataFrame:
    """Equal-width bins over the range of ``value`` within ``keys`` (last bin closed),
    counts and density per ``by`` group (e.g. label)."""
    keys = list(keys)
    v = F.col(value).cast("double")
    rng = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    x = df.join(rng, keys) if keys else df.withColumn("_o", F.lit(1)).join(
        F.broadcast(rng.withColumn("_o", F.lit(1))), "_o").drop("_o")
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((v - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    grp = keys + ([by] if by else [])
    counts = x.where(v.isNotNull()).groupBy(*grp, "_lo", "_hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = x.where(v.isNotNull()).groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counts.join(tot, grp) .select(
        *grp, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_left"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_right"), "n",
        F.when(width > 0, F.col("n") / (F.col("_n") * width)).alias("density"))


def kde_grid(df: DataFrame, keys: list[str], value: str, grid: int = 100,
             bandwidth: float | None = None) -> DataFrame:
    """H9: Gaussian KDE evaluated on ``grid`` points spanning each group's range.

    Bandwidth: Scott's rule ``σ·n^(-1/5)`` (sample σ) unless given.  Rows
    are first counted by distinct value, so each *value* contributes once to
    every grid point of its group.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    stats = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(v).alias("_sd"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    h = F.lit(float(bandwidth)) if bandwidth else F.col("_sd") * F.pow(F.col("_n").cast("double"), -0.2)
    stats = stats.withColumn("_h", h)
    x = df.where(v.isNotNull()).groupBy(*keys, v.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    x = x.join(stats, keys) if keys else x.withColumn("_o", F.lit(1)).join(
        F.broadcast(stats.withColumn("_o", F.lit(1))), "_o").drop("_o")
    step = (F.col("_hi") - F.col("_lo")) / (grid - 1)
    pts = x.select(*keys, "_x", "_c", "_h", "_n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.col("_lo") + i * step)).alias("gi", "g"))
    contrib = F.col("_c") * F.exp(-F.pow(F.col("_x") - F.col("g"), 2) / (2 * F.col("_h") * F.col("_h")))
    out = pts.groupBy(*keys, "gi", "g", "_h", "_n").agg(F.sum(contrib).alias("_s"))
    return out.select(*keys, "gi", "g", (F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))
