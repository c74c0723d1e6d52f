"""Label columns that hold one class, in ANSI mode, where a division by zero is an error."""

import numpy as np
import pytest

from spreadlens.operators import hypothesis as H
from spreadlens.operators import rollup as R
from spreadlens.plans.catalog import spearman_pearson
from spreadlens.sources.fixtures import feature_long


@pytest.fixture
def ansi(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    yield spark
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_features_of_a_label_that_never_varies(ansi):
    df = ansi.createDataFrame([(f"q{i}", float(i), float(-i * i), 0) for i in range(6)], "id string, a double, b double, label int")
    ks = H.ks_tests(feature_long(df, ["a", "b"], ["label"]), ["feature"], n_tests=2)
    assert R.ordered_feature_union(df, ["a", "b"], "label", ks, 1).first().features == "a"
    assert {r.r for r in R.correlation_with(df, ["a", "b"], "label").collect()} == {None}
    pairs = {(r.f1, r.f2): r.r for r in R.correlation_matrix(df, ["a", "b", "label"]).collect()}
    assert pairs["a", "label"] is None and np.isclose(pairs["a", "b"], np.corrcoef(range(6), [-i * i for i in range(6)])[0, 1])
    got = spearman_pearson(df.withColumnRenamed("label", "c"), "a", "c", "id").first()
    assert (got.pearson, got.spearman, got.n) == (None, None, 6)


def test_correlation_leaves_out_rows_with_a_null(ansi):
    rows = [(1.0, 2.0), (2.0, 1.0), (4.0, 7.0), (None, 100.0), (50.0, None)]
    got = {(r.f1, r.f2): r.r for r in R.correlation_matrix(ansi.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert np.isclose(got["a", "b"], np.corrcoef([1, 2, 4], [2, 1, 7])[0, 1])
