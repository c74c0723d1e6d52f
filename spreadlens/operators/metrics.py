"""Evaluation metrics as grouped DataFrame jobs (survey items J1–J8).

Rank-based metrics start from a value-count table — one row per
``(keys, score)`` with the positives ``c1`` and negatives ``c0`` at that
score — which collapses ties and shrinks the data before any ordering.
Running totals come from ``ranking.prefix_sums`` (no global window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import safe_div
from .ranking import prefix_sums

DEFAULT_THRESHOLDS = (0.2, 0.3, 0.5, 0.7, 0.8)


def score_counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    y = F.col(label).cast("int")
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(*keys, F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).cast("long").alias("c1"), F.sum(1 - y).cast("long").alias("c0")))


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))


def ranked_counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """One row per distinct score: class counts, running counts from below (``cum1``, ``cum0``) and the group's totals."""
    keys = list(keys)
    cum = prefix_sums(score_counts(df, keys, score, label), keys, ["score"], {"cum1": F.col("c1"), "cum0": F.col("c0")})
    tot = _totals(cum, keys)
    return cum.join(tot, keys) if keys else cum.crossJoin(F.broadcast(tot))  # one row of totals


def _auc(c1="c1", c0="c0", cum0="cum0"):
    both = (F.max("n1") > 0) & (F.max("n0") > 0)
    return F.when(both, F.sum(F.col(c1) * (F.col(cum0) - 0.5 * F.col(c0))) / (F.max("n1") * F.max("n0")))


def _above():
    """Rows of class 1 and of class 0 at or above the score."""
    return F.col("n1") - F.col("cum1") + F.col("c1"), F.col("n0") - F.col("cum0") + F.col("c0")


def _ap():
    tp, fp = _above()
    return F.when(F.max("n1") > 0, F.sum(F.col("c1") * tp / (tp + fp)) / F.max("n1"))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Exact ROC AUC with ties, ``(keys, n1, n0, auc)``.

    AUC = Σ_s c1(s)·(C0(<s) + c0(s)/2) / (n1·n0); null for a single class.
    """
    return ranked_counts(df, keys, score, label).groupBy(*keys).agg(
        F.max("n1").alias("n1"), F.max("n0").alias("n0"), _auc().alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Step-wise AP = Σ over distinct thresholds (descending) of ΔRecall·Precision."""
    return ranked_counts(df, keys, score, label).groupBy(*keys).agg(_ap().alias("average_precision"))


def curve_points(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """ROC and PR points at every distinct threshold (no point dropping)."""
    tp, fp = _above()
    x = ranked_counts(df, keys, score, label).withColumns({"tp": tp, "fp": fp})
    return x.select(*keys, F.col("score").alias("threshold"), "tp", "fp",
                    safe_div("tp", "n1").alias("tpr"), safe_div("fp", "n0").alias("fpr"),
                    safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div("tp", "n1").alias("recall"))


def mean_curve(df: DataFrame, keys: list[str], fold: str, score: str, label: str, points: int = 100) -> DataFrame:
    """Mean ROC over folds: each fold's TPR interpolated at ``points`` false-positive rates, then averaged.

    The curve of a fold starts at (0, 0); folds with one class give none.
    Between curve points TPR is linear in FPR; at a vertical step the upper end counts.
    """
    keys = list(keys)
    tp, fp = _above()
    pts = ranked_counts(df, [*keys, fold], score, label).filter("n1 > 0 and n0 > 0").select(
        *keys, fold, (fp / F.col("n0")).alias("x"), (tp / F.col("n1")).alias("y"))
    start = pts.select(*keys, fold).distinct().select(*keys, fold, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    grid = start.select(*keys, fold, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    marks = grid.select(*keys, fold, (F.col("g") / F.lit(points - 1)).alias("x"), F.lit(None).cast("double").alias("y"), "g")
    # the grid points of a fold lie among its curve points: the last one at or below and the first one above give the line
    every = pts.union(start).withColumn("g", F.lit(None).cast("int")).union(marks)
    order = Window.partitionBy(*keys, fold).orderBy("x", F.col("g").isNotNull(), F.col("y").asc_nulls_last())
    lo = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = order.rowsBetween(1, Window.unboundedFollowing)
    near = every.withColumns({
        "lo": F.last(F.when(F.col("y").isNotNull(), F.struct("x", "y")), ignorenulls=True).over(lo),
        "hi": F.first(F.when(F.col("y").isNotNull(), F.struct("x", "y")), ignorenulls=True).over(hi)}).filter("g is not null")
    slope = F.try_divide(F.col("hi.y") - F.col("lo.y"), F.col("hi.x") - F.col("lo.x"))
    tpr = F.when(F.col("hi").isNull() | (F.col("x") == F.col("lo.x")), F.col("lo.y")).otherwise(
        F.col("lo.y") + (F.col("x") - F.col("lo.x")) * slope)
    return near.select(*keys, fold, "g", F.col("x").alias("fpr"), tpr.alias("tpr")).groupBy(*keys, "g", "fpr").agg(
        F.avg("tpr").alias("mean_tpr"), F.count(F.lit(1)).alias("n_folds"))


def _confusion_sums(df: DataFrame, keys: list[str], prob: str, label: str, thresholds) -> DataFrame:
    y = F.col(label).cast("int")
    aggs = []
    for i, t in enumerate(thresholds):
        pred = (F.col(prob) >= t).cast("int")
        aggs += [F.sum(pred * y).alias(f"tp{i}"), F.sum(pred * (1 - y)).alias(f"fp{i}"),
                 F.sum((1 - pred) * (1 - y)).alias(f"tn{i}"), F.sum((1 - pred) * y).alias(f"fn{i}")]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"fp{i}").alias("fp"), F.col(f"tn{i}").alias("tn"),
                              F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def threshold_table(df: DataFrame, keys: list[str], prob: str, label: str,
                    thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
    """Confusion counts and rates at each threshold (``p >= thr``)."""
    c = _confusion_sums(df, list(keys), prob, label, thresholds)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    return c.select(*keys, "threshold",
                    ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    F.when(tn + fp > 0, tn / (tn + fp)).alias("specificity"),
                    "tp", "fp", "tn", "fn")


def classification_metrics(df: DataFrame, keys: list[str], prob: str, label: str) -> DataFrame:
    """J4 (+J1, J2): AUC, AP, Brier and accuracy/precision/recall/F1 at 0.5, all from one table of score counts."""
    s, n = F.col("score"), F.max("n1") + F.max("n0")
    up = s >= 0.5
    sums = ranked_counts(df, keys, prob, label).groupBy(*keys).agg(
        _auc().alias("roc_auc"), _ap().alias("average_precision"),
        (F.sum(F.col("c1") * (s - 1) * (s - 1) + F.col("c0") * s * s) / n).alias("brier_score"),
        F.coalesce(F.sum(F.when(up, F.col("c1"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(up, F.col("c0"))), F.lit(0)).alias("fp"),
        F.max("n1").alias("n1"), F.max("n0").alias("n0"))
    tp, fp, n1, n0 = (F.col(c) for c in ("tp", "fp", "n1", "n0"))
    return sums.select(*keys, "roc_auc", "average_precision", "brier_score", ((tp + n0 - fp) / (n1 + n0)).alias("accuracy_at_0_5"),
                       safe_div(tp, tp + fp).alias("precision_at_0_5"), safe_div(tp, n1).alias("recall_at_0_5"),
                       safe_div(2 * tp, tp + fp + n1).alias("f1_at_0_5"))


def calibration_bins(df: DataFrame, keys: list[str], prob: str, label: str, n_bins: int = 10) -> DataFrame:
    """Uniform bins (right-closed, as the public scikit-learn helper), empty bins absent."""
    b = F.greatest(F.ceil(F.col(prob) * n_bins / (1.0 + 1e-8)) - 1, F.lit(0)).cast("int")
    return (df.groupBy(*keys, b.alias("bin"))
            .agg(F.avg(F.col(prob)).alias("prob_pred"), F.avg(F.col(label).cast("double")).alias("prob_true"),
                 F.count(F.lit(1)).alias("n")))


def feature_auc(long: DataFrame, keys: list[str], label: str) -> DataFrame:
    """AUC of each feature used directly as a score (``long`` has feature, value)."""
    return auc(long, list(keys) + ["feature"], "value", label)


def transfer_ratio(cross: DataFrame, in_domain: DataFrame, on: list[str]) -> DataFrame:
    """``auc(transfer) / auc(in-domain)`` for matching rows."""
    return (cross.withColumnRenamed("auc", "auc_transfer")
            .join(in_domain.withColumnRenamed("auc", "auc_in_domain"), on)
            .withColumn("preservation", F.col("auc_transfer") / F.col("auc_in_domain")))
