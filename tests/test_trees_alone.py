"""Trees of rows that one task may hold, against the same trees grown a Spark job a level."""

import numpy as np

from spreadlens.operators import batch_trees as BT
from spreadlens.operators.partials import matrix


def _scores(rows, models):
    fitted = BT.fit(rows, models, 3)
    got = fitted.scores(["m"], held_out=False).collect()
    return fitted, {(r["m"], r["id"]): r["p"] for r in got}


def test_a_batch_more_of_rows_still_grows_in_one_job(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = (x[:, 0] + rng.normal(size=150) > 0).astype(int)
    df = spark.createDataFrame([(f"{i}", *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))],
                               "id string, a double, b double, c double, y int").repartition(3)
    rows = matrix(df, "id", "y", ["a", "b", "c"])
    models = [BT.Ensemble(("deep",), (0, 1, 2), trees=7, depth=None, min_leaf=2), BT.adaboost(("ada",), (0, 1, 2), trees=4, rate=0.5),
              BT.gradient(("boost",), (0, 2), trees=3, depth=2)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "40")  # the rows are more than an Arrow batch holds
    try:
        # histograms of a few nodes at a time
        monkeypatch.setattr(BT, "CHUNK_BYTES", 1 << 16)
        one, alone = _scores(rows, models)
        monkeypatch.setattr(BT, "ALONE_ROWS", 0)
        many, levels = _scores(rows, models)
    finally:
        spark.conf.set(name, before)
    assert one.jobs == 1 and many.jobs > 10
    assert alone.keys() == levels.keys() and len(alone) == 450
    assert all(np.isclose(alone[k], levels[k], rtol=0, atol=1e-6) for k in alone)
