"""Batched linear models and trees against single fits and plain versions."""
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from spreadlens.operators import batch_linear as BL
from spreadlens.operators import batch_trees as BT
from spreadlens.operators.partials import EVERY, Split, matrix

NAMES = ["a", "b", "c", "d"]


def sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4)) * [1, 5, 0.1, 2] + [0, 1000, 3, -2]
    y = (x[:, 0] + (x[:, 1] - 1000) / 5 + rng.standard_normal(n) > 0.4).astype(int)
    return [(f"r{i}", *map(float, v), int(k), str(i % 3), "g" if i % 4 else None) for i, (v, k) in enumerate(zip(x, y, strict=True))]


SCHEMA = "id string, a double, b double, c double, d double, y int, fold string, grp string"


def test_batched_models_equal_single_fits(spark):
    df = spark.createDataFrame(sample(), SCHEMA).repartition(5)
    models = [BL.Linear((kind, s, f), fs, Split("fold", f), c, l1, bal)
              for kind, c, l1, bal in (("l2", 1.0, 0.0, False), ("en", 0.1, 0.5, False), ("bal", 0.05, 0.25, True))
              for s, fs in (("all", (0, 1, 2, 3)), ("two", (3, 0))) for f in ("0", "2")]
    rows = matrix(df, "id", "y", NAMES, ["fold", "grp"])
    fitted = BL.fit(rows, models, 4, ["fold", "grp"])
    assert fitted.passes < 30
    for m, got in zip(models, fitted.inputs, strict=True):
        train = df.where(F.col("fold") != m.names[2])
        cols = [NAMES[f] for f in m.features]
        st = train.agg(*[F.avg(c).alias("m" + c) for c in cols], *[F.stddev_pop(c).alias("s" + c) for c in cols], F.count("*").alias("n"), F.sum("y").alias("n1")).first()
        z = train.select(F.col("y").cast("double").alias("label"), *[((F.col(c) - st["m" + c]) / st["s" + c]).alias(c) for c in cols],
                         F.when(F.col("y") == 1, st["n"] / 2 / st["n1"]).otherwise(st["n"] / 2 / (st["n"] - st["n1"])).alias("w"))
        lr = LogisticRegression(regParam=1 / (m.c * st["n"]), elasticNetParam=m.l1_ratio, standardization=False, maxIter=500, tol=1e-12,
                                **({"weightCol": "w"} if m.balanced else {})).fit(VectorAssembler(inputCols=cols, outputCol="features").transform(z))
        assert np.allclose(got, [*lr.coefficients.toArray(), lr.intercept], atol=1e-4), m
    out = fitted.scores(rows, ["kind", "set", "held"])
    assert out.count() == sum((int(f) == i % 3) for m in models for f in [m.names[2]] for i in range(400))
    assert out.where("trained").count() == 0 and out.columns == ["kind", "set", "held", "id", "y", "p", "trained"]
    assert fitted.scores(rows, ["kind", "set", "held"], held_out=False).count() == 400 * len(models)
    assert fitted.coefficients(rows, ["kind", "set", "held"], NAMES).count() == 6 * 4 + 6 * 2


def test_components_are_the_same_model_turned(spark):
    """With all components and no l1 the turned model scores as the plain one; whitened ones differ by the penalty only."""
    df = spark.createDataFrame(sample(), SCHEMA).repartition(3)
    rows = matrix(df, "id", "y", NAMES, ["grp"])
    same = [BL.Linear(("plain",), (0, 1, 2, 3)), BL.Linear(("turned",), (0, 1, 2, 3), components=9), BL.Linear(("white",), (0, 1, 2, 3), c=1e6, components=4, whiten=True),
            BL.Linear(("free",), (0, 1, 2, 3), c=1e6), BL.Linear(("one",), (0, 1, 2, 3), components=1), BL.Linear(("null",), (0,), Split("grp", "g", True))]
    fitted = BL.fit(rows, same, 4, ["grp"])
    c = fitted.coef
    assert np.allclose(c[:, 0], c[:, 1], atol=1e-6) and np.allclose(c[:, 2], c[:, 3], rtol=1e-3, atol=1e-3) and len(fitted.inputs[4]) == 2
    assert fitted.scores(rows, ["m"]).where("m = 'null'").count() == 100  # null groups train no one and are held out


def test_one_class_constant_features_and_no_rows(spark):
    df = spark.createDataFrame([(f"{i}", 1.0, float(i), 0.0, 1.0, int(i < 5), "01"[i < 5], None) for i in range(10)], SCHEMA)
    rows = matrix(df, "id", "y", NAMES, ["fold"])
    models = [BL.Linear(("x",), (0, 1), Split("fold", "0")), BL.Linear(("y",), (0, 2)), BL.Linear(("z",), (1, 3), l1_ratio=0.5)]
    fitted = BL.fit(rows, models, 4, ["fold"])
    assert fitted.usable.tolist() == [False, True, True] and np.isfinite(fitted.coef).all()
    assert fitted.scores(rows, ["m"], held_out=False).where("m = 'x'").count() == 0
    none = matrix(df.limit(0), "id", "y", NAMES, ["fold"])
    assert BL.fit(none, models, 4, ["fold"]).scores(none, ["m"], held_out=False).count() == 0
    with pytest.raises(Exception, match="finite"):
        BL.fit(matrix(df.withColumn("a", F.lit(None).cast("double")), "id", "y", NAMES), [BL.Linear(("x",), (0,), EVERY)], 4)


# ---------------------------------------------------------------- trees


def plain_tree(x, y, depth, kind, min_leaf=1, ridge=0.0, rate=1.0, w=None, score=None):
    """A tree by trying every threshold of every feature; returns its value at each row of x."""
    if kind == "forest":
        a, b = w, w * y
        purity = lambda n, n1: (n1 * n1 + (n - n1) ** 2) / n if n > 1e-12 else 0.0
        value = lambda k: b[k].sum() / a[k].sum()
    else:
        p = 1 / (1 + np.exp(-score))
        a, b = p * (1 - p), y - p
        value = lambda k: rate * b[k].sum() / (a[k].sum() + ridge)
        purity = (lambda n, g: g * g / n) if kind == "gradient" else (lambda h, g: g * g / (h + ridge))
    size = np.ones(len(y)) if kind == "gradient" else a
    out = np.empty(len(y))

    def grow(k, level):
        out[k] = value(k)
        best = (1e-12, None)
        whole = purity(size[k].sum(), b[k].sum())
        for f in range(x.shape[1]) if level < depth else ():
            for t in np.unique(x[k, f])[:-1]:
                l, r = k[x[k, f] <= t], k[x[k, f] > t]
                if min(len(l), len(r)) < min_leaf or (kind == "second_order" and min(a[l].sum(), a[r].sum()) < 1):
                    continue
                gain = purity(size[l].sum(), b[l].sum()) + purity(size[r].sum(), b[r].sum()) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, (l, r))
        if best[1]:
            for side in best[1]:
                grow(side, level + 1)

    grow(np.flatnonzero(a > 0), 0)
    return out


def few_values(n=120, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (rng.random(n) < 0.2) | (x[:, 1] > 9)).astype(int)
    return x, y


@pytest.mark.parametrize("partitions", [1, 4])
def test_boosted_trees_equal_plain_ones(spark, partitions):
    x, y = few_values()
    df = spark.createDataFrame([(f"{i}", *map(float, v), int(k), str(i % 2)) for i, (v, k) in enumerate(zip(x, y, strict=True))],
                               "id string, a double, b double, c double, y int, fold string").repartition(partitions)
    rows = matrix(df, "id", "y", ["a", "b", "c"], ["fold"])
    models = [BT.gradient(("g",), (0, 1, 2), trees=4, depth=2), BT.second_order(("s",), (0, 1, 2), trees=12, depth=3, rate=0.3),
              BT.gradient(("f",), (0, 2), Split("fold", "1"), trees=3, depth=2)]
    fitted = BT.fit(rows, models, 3, ["fold"])
    got = {(r["m"], int(r["id"])): r["p"] for r in fitted.scores(["m"], held_out=False).collect()}
    for name, cols, own, kind, trees, depth, rate, ridge in (("g", [0, 1, 2], np.arange(120), "gradient", 4, 2, 0.1, 0.0), ("s", [0, 1, 2], np.arange(120), "second_order", 12, 3, 0.3, 1.0),
                                                             ("f", [0, 2], np.arange(0, 120, 2), "gradient", 3, 2, 0.1, 0.0)):
        share = y[own].mean()
        score = np.full(len(own), np.log(share / (1 - share)) if kind == "gradient" else 0.0)
        for _ in range(trees):
            score += plain_tree(x[own][:, cols], y[own], depth, kind, ridge=ridge, rate=rate, score=score)
        assert np.allclose([got[name, i] for i in own], 1 / (1 + np.exp(-score)), atol=1e-5), name


def test_forests_equal_plain_trees_and_hold_out(spark):
    x, y = few_values()
    df = spark.createDataFrame([(f"{i}", float(v[0]), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id string, a double, y int").repartition(3)
    rows = matrix(df, "id", "y", ["a"])
    models = [BT.Ensemble(("one",), (0,), trees=3, depth=2), BT.Ensemble(("rep",), (0,), trees=2, depth=None, min_leaf=2, replicate=5)]
    fitted = BT.fit(rows, models, 1)
    got = {(r["m"], int(r["id"])): (r["p"], r["trained"]) for r in fitted.scores(["m"], held_out=False).collect()}
    draw = {int(r["id"]): r["d"] for r in df.select("id", F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("bigint").alias("d")).collect()}
    draws = np.array([draw[i] for i in range(120)], np.int64).view(np.uint64)
    for m, numbers, rep, depth, least in (("one", [42, 43, 44], None, 2, 1), ("rep", [42 + 5 * 100_003, 43 + 5 * 100_003], 5, 99, 2)):
        count = np.ones(120, int) if rep is None else BT.replicate_counts(draws, np.array([rep]))[:, 0]
        weight = BT.poisson(BT.uniform(draws, np.array(numbers), 2), np.repeat(count[:, None], len(numbers), 1)).astype(float)
        want = np.zeros(120)
        for t in range(len(numbers)):
            leaf = plain_tree(x[:, :1], y, depth, "forest", least, w=weight[:, t])
            known = {v: leaf[(x[:, 0] == v) & (weight[:, t] > 0)][:1] for v in np.unique(x[:, 0])}
            want += [known[v][0] if len(known[v]) else np.nan for v in x[:, 0]]
        own = np.array([got[m, i][0] for i in range(120)])
        ok = ~np.isnan(want)
        assert ok.sum() > 100 and np.allclose(own[ok], want[ok] / len(numbers)), m
        if rep is not None:
            assert [got[m, i][1] for i in range(120)] == (count > 0).tolist() and 0.2 < (count == 0).mean() < 0.55
            assert fitted.scores(["m"]).where("m = 'rep'").count() == (count == 0).sum()


def test_poisson_draws_and_feature_draws(spark):
    u = BT.uniform(np.arange(4000).astype(np.uint64), np.arange(20), 7)
    n = BT.poisson(u)
    assert abs(n.mean() - 1) < 0.02 and abs((n == 0).mean() - np.exp(-1)) < 0.01 and abs(BT.poisson(u, 3).mean() - 3) < 0.03
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6))
    y = (x.sum(1) > 0).astype(int)
    df = spark.createDataFrame([(f"{i}", *map(float, v), int(k), str(i % 3)) for i, (v, k) in enumerate(zip(x, y, strict=True))],
                               "id string, a double, b double, c double, d double, e double, f double, y int, fold string").repartition(3)
    rows = matrix(df, "id", "y", list("abcdef"), ["fold"])
    models = [BT.Ensemble((k, f), tuple(range(6)), Split("fold", f), trees=60, depth=6) for k in ("forest",) for f in "012"]
    models += [BT.adaboost(("ada", f), tuple(range(6)), Split("fold", f), trees=40, rate=0.5) for f in "012"]
    out = BT.fit(rows, models, 6, ["fold"]).scores(["kind", "fold"]).toPandas()
    assert len(out) == 600 and not out.trained.any()
    for kind, own in out.groupby("kind"):
        assert (own.p.rank()[own.y == 1].sum() - (own.y == 1).sum() * ((own.y == 1).sum() + 1) / 2) / ((own.y == 1).sum() * (own.y == 0).sum()) > 0.88, kind
    none = matrix(df.limit(0), "id", "y", list("abcdef"), ["fold"])
    assert BT.fit(none, models[:1] + models[3:4], 6, ["fold"]).scores(["kind", "fold"]).count() == 0


def test_adaboost_follows_the_plain_rule(spark):
    x, y = few_values(seed=8)
    df = spark.createDataFrame([(f"{i}", *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id string, a double, b double, c double, y int").repartition(2)
    got = {int(r["id"]): r["p"] for r in BT.fit(matrix(df, "id", "y", ["a", "b", "c"]), [BT.adaboost(("x",), (0, 1, 2), trees=12, rate=0.5)], 3).scores(["m"], held_out=False).collect()}
    weight, score = np.ones(len(y)), np.zeros(len(y))
    for _ in range(12):
        share = plain_tree(x, y, 1, "forest", w=weight)
        pred = (share > 0.5).astype(int)
        err = weight[pred != y].sum() / weight.sum()
        alpha = 0.5 * np.log((1 - err) / err)
        weight = weight * np.exp(alpha * (pred != y))
        score += alpha * (2 * pred - 1)
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-2 * score)), atol=1e-4)
