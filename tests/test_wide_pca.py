import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import wide_pca as W


def dense(x, k, scaled):
    z = x - x.mean(0)
    if scaled:
        sd = z.std(0, ddof=1)
        z = np.where(sd > 0, z / np.where(sd > 0, sd, 1), 0)
    e, v = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(-e)[:k]
    return e[order], v[:, order], z


@pytest.mark.parametrize(("width", "scaled"), [(120, False), (120, True), (8, True)])
def test_components_equal_the_dense_ones(spark, width, scaled):
    rng = np.random.default_rng(width)
    x = rng.standard_normal((300, width)) @ (rng.standard_normal((width, width)) * np.linspace(3, 0.1, width)[:, None]) + 100
    x[:, 3] = 5.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id int, v array<double>").repartition(4)
    m = W.fit(df, "v", 5, scaled)
    e, v, z = dense(x, 5, scaled)
    assert np.allclose(m.variance, e, rtol=1e-7) and m.rows == 300 and np.isclose(m.total, np.cov(z.T).trace())
    assert np.abs(np.abs((m.axes * v).sum(0)) - 1).max() < 1e-6
    got = {r["id"]: r["z"] for r in m.project(df.where("v is not null"), "v").collect()}
    assert np.allclose(np.abs([got[i] for i in range(300)]), np.abs(z @ v), atol=1e-3 * np.abs(z @ v).max())
    white = np.array([r["z"] for r in m.project(df.where("v is not null"), "v", whiten=True).collect()])
    assert np.allclose(np.cov(white.T), np.eye(5), atol=1e-5)
    assert m.table(spark).agg(F.max("cumulative")).first()[0] == pytest.approx(e.sum() / np.cov(z.T).trace())


def test_save_wide_and_empty(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 6720))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id int, v array<double>").repartition(2)
    m = W.fit(df, "v", 3)
    assert m.variance.sum() / m.total == pytest.approx(1, abs=1e-6) and m.axes.shape == (6720, 3)
    m.save(spark, str(tmp_path / "pca"))
    again = W.Components.load(spark, str(tmp_path / "pca"))
    a, b = ({r["id"]: r["z"] for r in x.project(df, "v").collect()} for x in (m, again))
    assert a == b and len(a[0]) == 3
    assert W.fit(df.limit(0), "v", 3) is None
    with pytest.raises(Exception, match="entries"):
        W.fit(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v", 1)
