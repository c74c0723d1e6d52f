import random

import pytest
from pyspark.sql import functions as F

from spreadlens.operators import attention as A
from spreadlens.operators import hypothesis as H
from spreadlens.operators import metrics as M
from spreadlens.operators import models as MO
from spreadlens.operators import resample as RS
from spreadlens.operators import rollup as R


@pytest.fixture(scope="module")
def opposite(spark):
    """Two domains whose label follows the feature with opposite signs, and one with a single class."""
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        d = "up" if i % 2 else "down"
        x = rnd.gauss(0, 1)
        rows.append((f"r{i}", d, x, rnd.gauss(0, 1), int((x > 0) == (d == "up"))))
    rows += [(f"s{i}", "single", rnd.gauss(0, 1), 0.0, 1) for i in range(20)]
    return spark.createDataFrame(rows, "row_id string, domain string, x double, z double, y int").checkpoint()


def test_each_group_gets_its_own_model(opposite):
    got = {r.domain: r for r in MO.per_group_cv(opposite, "domain", ["x", "z"], "y", ["logistic"], folds=3).collect()}
    assert set(got) == {"up", "down"}
    assert got["up"].auc_mean > 0.9 and got["down"].auc_mean > 0.9 and got["up"].folds == 3
    pooled = MO.holdout_eval(opposite.where("domain <> 'single'"), ["x", "z"], "y", "logistic").first()
    assert pooled.roc_auc < 0.8


def test_groups_come_from_the_data(opposite):
    two = opposite.where("domain <> 'single'")
    lobo = {r.held_out: r for r in MO.leave_one_out(two, "domain", ["x"], "y", "logistic").collect()}
    assert set(lobo) == {"up", "down"} and lobo["up"].auc < 0.2 and lobo["up"].train_auc > 0.9
    cross = {(r.train, r.test): r.auc for r in MO.transfer_matrix(two, "domain", ["x"], "y", "logistic").collect()}
    assert len(cross) == 4 and cross["up", "up"] > 0.9 and cross["up", "down"] < 0.1


def test_final_evaluation_bundle(opposite):
    b = MO.final_evaluation(opposite.where("domain = 'up'"), ["z", "x"], "y", "logistic")
    assert set(b) == {"metrics", "thresholds", "curve", "predictions", "coefficients"}
    assert [r.feature for r in b["coefficients"].collect()] == ["x", "z"]
    assert b["metrics"].first().roc_auc > 0.9 and b["thresholds"].count() == 5


def test_permutation_importance_finds_the_feature(opposite):
    got = {r.feature: r.importance for r in MO.permutation_importance(opposite.where("domain = 'up'"), ["x", "z"], "y", "row_id", repeats=2).collect()}
    assert got["x"] > 0.2 > abs(got["z"])


def test_short_sequences_and_gaps_are_reported(spark):
    rows = [("a", 0, h, r, float(r)) for h in (0, 1) for r in (1, 2, 3)] + [("b", 0, h, r, float(r)) for h in (0, 1) for r in (1, 2)]
    rows += [("c", 0, 0, r, float(r)) for r in (1, 2, 3)]
    eig = spark.createDataFrame(rows, "id string, layer int, head int, rank int, eig double")
    got = {r.id: r for r in A.eigen_vectors(eig, 1, 2, 3).collect()}
    assert got["a"].complete and got["b"].complete and not got["c"].complete and len(got["b"].features) == 4
    with pytest.raises(Exception, match="expected 6 values"):
        A.whole_vectors(A.eigen_vectors(eig, 1, 2, 3), 6).collect()
    assert {(r.id, r.rank): r.mean_eig for r in A.head_mean(eig).collect()}["a", 2] == 2.0


def test_one_class_groups_stay(spark):
    rows = [("g", i % 2, float(i)) for i in range(30)] + [("one", 1, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, label int, value double").withColumn("id", F.monotonically_increasing_id().cast("string"))
    mwu = {r.k: r for r in H.mann_whitney(df, ["k"]).collect()}
    assert mwu["one"].p_value is None and mwu["g"].p_value is not None
    assert {r.k: (r.n_cells, r.n_finite) for r in H.significant_share(H.mann_whitney(df, ["k"]), ["k"]).collect()} == {"g": (1, 1), "one": (1, 0)}
    boot = {r.k: r for r in RS.bootstrap_mean_diff(df, ["k"], "id", "value", "label", n_boot=20).collect()}
    assert (boot["one"].n_pos, boot["one"].n_neg, boot["one"].delta_obs) == (5, 0, None) and boot["g"].n_replicates == 20


def test_effect_size_ignores_infinities(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, float("inf")), (0, 0.0), (0, 1.0), (0, float("nan"))], "label int, value double")
    r = H.cohens_d(df, []).first()
    assert (r.n1, r.n0) == (2, 2) and r.cohens_d == pytest.approx(1.5 / (1.25 ** 0.5))


def test_mean_curve_interpolates(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (0, 0.8, 0), (0, 0.7, 1), (0, 0.1, 0), (1, 0.9, 1), (1, 0.2, 0), (2, 0.5, 1)], "fold int, p double, y int")
    got = {round(r.fpr, 2): (r.mean_tpr, r.n_folds) for r in M.mean_curve(df, [], "fold", "p", "y", points=5).collect()}
    # fold 0 passes (0, .5), (.5, .5), (.5, 1), (1, 1); fold 1 is 1 from the start; fold 2 has one class
    assert got[0.25] == (0.75, 2) and got[0.5] == (1.0, 2) and got[1.0] == (1.0, 2) and got[0.0] == (0.75, 2)


def test_features_are_joined_in_the_right_order(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(200):
        y = i % 2
        rows.append((y, y + rnd.gauss(0, 3), 5.0 * y + rnd.gauss(0, 1), rnd.gauss(0, 1), y * rnd.choice([-1, 1]) * 4.0 + rnd.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "label int, a double, b double, c double, d double")
    feats = ["d", "c", "b", "a"]
    long = df.unpivot(["label"], feats, "feature", "value")
    got = R.ordered_feature_union(df, feats, "label", H.ks_tests(long, ["feature"], n_tests=4), 1).first().features
    assert got.split(",")[0] == "b" and got.split(",")[1] == "d" and "c" not in got
