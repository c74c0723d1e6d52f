"""Forests without a depth limit, grown by tasks that hold all rows, against the same trees grown a Spark job a level."""

import numpy as np
import pytest

from spreadlens.operators import batch_trees as BT
from spreadlens.operators.partials import EVERY, Split, matrix


def rows_of(spark, n=400, seed=5):
    """Ids that repeat, a missing value, a feature that never varies, and one with few values."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)), 2)
    x[:, 4], x[:, 5] = 1.0, rng.integers(0, 2, n)
    y = (x[:, 0] + x[:, 1] * x[:, 5] + rng.normal(size=n) > 0).astype(int)
    data = [(f"{i % (n - 20)}", *map(float, v), int(k), str(i % 3)) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    data[7] = (*data[7][:1], None, *data[7][2:])
    df = spark.createDataFrame(data, "id string, a double, b double, c double, d double, e double, f double, y int, fold string").repartition(4)
    return matrix(df, "id", "y", list("abcdef"), ["fold"])


def scores(rows, models, held_out):
    fitted = BT.fit(rows, models, 6, ["fold"])
    return fitted, sorted((r["m"], r["id"], r["y"], r["trained"], round(r["p"], 9)) for r in fitted.scores(["m"], held_out).collect())


@pytest.mark.parametrize("alone", [0, 32768])
def test_deep_forests_need_no_job_a_level(spark, monkeypatch, alone):
    rows = rows_of(spark)
    deep = [BT.Ensemble(("fold",), tuple(range(6)), Split("fold", "1"), trees=9, depth=None, min_leaf=2),
            BT.Ensemble(("some",), (0, 4, 5), trees=1, depth=None), BT.Ensemble(("rep",), tuple(range(6)), trees=3, depth=None, replicate=4)]
    # the features of the first wave are those of all models: a model of some has a wave of its own
    models = {"deep": [deep[0], deep[2]], "some": [deep[1]], "mixed": [BT.Ensemble(("flat",), tuple(range(6)), trees=4, depth=3), deep[0], BT.adaboost(("ada",), (0, 1), trees=3)]}
    monkeypatch.setattr(BT, "ALONE_ROWS", alone)
    for name, own in models.items():
        for held_out in (True, False):
            fitted, got = scores(rows, own, held_out)
            if name != "mixed":
                assert fitted.grower.jobs == 1 and fitted.jobs == 0
            with monkeypatch.context() as m:
                m.setattr(BT, "DEEP_BYTES", 0)
                levels, want = scores(rows, own, held_out)
            assert not levels.grower.deep and (alone or levels.jobs > 5)
            assert got == want and (got or (name == "some" and held_out))


def test_a_deep_tree_is_the_same_node_for_node(monkeypatch):
    class Rows:
        n = 900

    rng, k = np.random.default_rng(2), Rows()
    k.bins = np.minimum(rng.integers(0, 64, (900, 9)), [63, 63, 63, 63, 0, 1, 3, 63, 63]).astype(np.uint8)
    k.y = ((k.bins[:, 0] > 30) ^ (rng.random(900) < 0.3)).astype(float)
    k.draws = rng.integers(0, 2**60, 900).astype(np.uint64)
    k.trains = np.ones((900, 1), bool)
    for cells in (BT.DEEP_CELLS, 64):  # all nodes at once, and a few at a time
        monkeypatch.setattr(BT, "DEEP_CELLS", cells)
        for least, depth in ((1, None), (2, None), (7, 5)):
            e = BT.Ensemble(("x",), tuple(range(9)), trees=1, depth=depth, min_leaf=least)
            own = np.array([0])
            w = BT.Wave([e], [EVERY], 1, {}, [], own, np.array([43]), BT.Trees(1), np.arange(1))
            BT.grow_levels(w, lambda w, f, d: BT.best_splits(w, BT.histogram(w, k, own, f, 64, None), own, f, d))
            got = BT.deep_tree(k, e, 43, BT.poisson(BT.uniform(k.draws, np.array([43]), 2))[:, 0], 64)
            for part in ("feature", "bin", "left", "value"):
                assert np.array_equal(getattr(got, part), getattr(w.trees, part)), (part, least, depth)
            assert np.array_equal(BT.reached(got, k.bins), w.trees.places(k.bins, own)[:, 0])
