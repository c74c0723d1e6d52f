import math
import random

import numpy as np
from pyspark.sql import functions as F

from spreadlens.operators import hypothesis as H
from spreadlens.operators import metrics as M


def _data(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.random() < 0.4
        rows.append((f"r{i}", "g", int(y), round(rnd.random() + 0.3 * y, 2)))
    return rows, spark.createDataFrame(rows, "id string, g string, y int, s double")


def _auc(rows):
    pos = [r[3] for r in rows if r[2] == 1]
    neg = [r[3] for r in rows if r[2] == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_exact_with_ties_and_symmetry(spark):
    rows, df = _data(spark)
    got = M.auc(df, ["g"], "s", "y").first().auc
    assert math.isclose(got, _auc(rows), rel_tol=1e-12)
    neg = M.auc(df.withColumn("s", -F.col("s")), ["g"], "s", "y").first().auc
    assert math.isclose(neg, 1 - got, rel_tol=1e-12)


def test_average_precision_step(spark):
    rows, df = _data(spark)
    ap = M.average_precision(df, ["g"], "s", "y").first().average_precision
    scores = sorted({r[3] for r in rows}, reverse=True)
    n1 = sum(r[2] for r in rows)
    exp = 0.0
    for t in scores:
        tp = sum(1 for r in rows if r[3] >= t and r[2] == 1)
        fp = sum(1 for r in rows if r[3] >= t and r[2] == 0)
        c1 = sum(1 for r in rows if r[3] == t and r[2] == 1)
        exp += c1 / n1 * tp / (tp + fp)
    assert math.isclose(ap, exp, rel_tol=1e-12)


def test_ks_statistic_brute_force_and_symmetry(spark):
    rows, df = _data(spark)
    long = df.select("g", F.col("s").alias("value"), F.col("y").alias("label"))
    got = H.ks_tests(long, ["g"]).first()
    a = np.array([r[3] for r in rows if r[2] == 1])
    b = np.array([r[3] for r in rows if r[2] == 0])
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= t).mean() - (b <= t).mean()) for t in grid)
    assert math.isclose(got.ks_stat, d, rel_tol=1e-12)
    assert 0 <= got.p_value <= 1
    flipped = H.ks_tests(long.withColumn("label", 1 - F.col("label")), ["g"]).first()
    assert math.isclose(flipped.ks_stat, got.ks_stat, rel_tol=1e-12)


def test_mann_whitney_u_matches_rank_sum(spark):
    rows, df = _data(spark)
    long = df.select("g", F.col("s").alias("value"), F.col("y").alias("label"))
    got = H.mann_whitney(long, ["g"]).first()
    assert math.isclose(got.u_stat / (got.n1 * got.n0), _auc(rows), rel_tol=1e-12)
    assert 0 <= got.p_value <= 1


def test_threshold_table_counts(spark):
    rows, df = _data(spark)
    t = {r.threshold: r for r in M.threshold_table(df, [], "s", "y", (0.5,)).collect()}[0.5]
    assert t.tp == sum(1 for r in rows if r[3] >= 0.5 and r[2] == 1)
    assert t.tp + t.fp + t.tn + t.fn == len(rows)
