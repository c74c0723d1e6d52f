"""Permutation importance over slices in numpy, and the hold-out split without an order of all rows, against plain code."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spreadlens.operators import dealt as DE
from spreadlens.operators import models as MO


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:7], 16)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(9)
    out = []
    for i in range(900):
        x = round(rnd.gauss(0, 1), 1)
        out.append((f"r{i}", x, rnd.choice([0.0, 1.0]), 3.0, int(x + rnd.gauss(0, 1) > 0)))
    return spark.createDataFrame(out, "row_id string, x double, z double, same double, y int").repartition(5).checkpoint()


def test_slices_give_the_auc_of_whole_tables(rows, monkeypatch):
    features = ["x", "z", "same"]
    sp = MO.stratified_split(rows, "row_id", "y", 0.2, 42).checkpoint()
    fitted, score = MO.fit_model(sp.where("not is_test"), features, "y", "logistic", 42)
    test = sp.where("is_test").select("row_id", "y", *features, F.monotonically_increasing_id().alias("at"))
    per, base = MO._dealt_scores(test, features, "y", "row_id", score, 2, 42)
    want, whole = {(r.feature, r["repeat"]): r.auc for r in per.collect()}, base.first()["base"]
    stats = score.stats.first()
    scorer = DE.Scorer([stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] for f in features], fitted.coefficients.toArray(), fitted.intercept)
    for deal, cut in ((100_000, 200_000), (20, 15), (1, 1)):  # one slice, many, and empty ones
        monkeypatch.setattr(DE, "SLICE_ROWS", deal)
        monkeypatch.setattr(DE, "SLICE_SCORES", cut)
        got, own = DE.dealt_auc(test, "row_id", "at", "y", features, scorer, 2, 42)
        assert {(r.feature, r["repeat"]): pytest.approx(r.auc, abs=1e-12) for r in got.collect()} == want
        assert own.first()["base"] == pytest.approx(whole, abs=1e-12)
    assert len(want) == 6 and want["same", 0] == whole > 0.7
    assert DE.dealt_auc(test.limit(0), "row_id", "at", "y", features, scorer, 2, 42) is None


def test_importance_follows_the_slices(rows, monkeypatch):
    called = []
    monkeypatch.setattr(DE, "SLICE_ROWS", 30)
    monkeypatch.setattr(MO, "dealt_auc", lambda *a: called.append(1) or DE.dealt_auc(*a))
    got = {r.feature: r for r in MO.permutation_importance(rows, ["x", "z", "same"], "y", "row_id", repeats=2).collect()}
    assert called and got["x"].importance > 0.1 > abs(got["z"].importance) and (got["same"].importance, got["same"].importance_std) == (0, 0)
    trees = {r.feature: r.importance for r in MO.permutation_importance(rows, ["x", "z"], "y", "row_id", model="random_forest_leaf", repeats=1).collect()}
    assert len(called) == 1 and trees["x"] > 0.1


def test_the_split_takes_the_first_draws_without_an_order_of_all_rows(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "b", None]), f"i{rnd.randrange(250)}", rnd.choice([0, 1, 1, None]), float(i)) for i in range(700)]
    data += [("c", "same", 1, 0.0)] * 9 + [("c", None, 0, 1.0)] * 5 + [("d", "one", 0, 2.0)]
    df = spark.createDataFrame(data, "k string, id string, y int, v double").repartition(3)
    for keys, share in ((None, 0.2), (["k"], 0.2), (["k"], 0.0), (None, 1.0)):
        sp = MO.stratified_split(df, "id", "y", share, 42, keys)
        assert "Window" not in sp._jdf.queryExecution().executedPlan().toString()
        got = sp.collect()
        place = (lambda r: (r[0], r[2])) if keys else (lambda r: r[2])
        known = [r for r in data if r[2] is not None and (not keys or r[0] is not None)]
        assert sorted(map(str, known)) == sorted(str((r.k, r.id, r.y, r.v)) for r in got) and sp.columns == [*(keys or []), "y", *[c for c in df.columns if c not in (*(keys or []), "y")], "is_test"]
        for c in {place(r) for r in known}:
            own = sorted((draw(42, *([r[1]] if r[1] else [])), r[1] or "") for r in known if place(r) == c)
            most = int(len(own) * share + 0.5)
            assert sorted((draw(42, *([r.id] if r.id else [])), r.id or "") for r in got if r.is_test and place((r.k, r.id, r.y)) == c) == own[:most], (keys, share, c)
