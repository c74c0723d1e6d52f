"""Work is done where the rows are: before shuffles, once an id, and without strings in the passes of a fit."""
import numpy as np
from pyspark.sql import functions as F

from spreadlens.functions.core import md5_uniform
from spreadlens.operators import batch_linear as BL
from spreadlens.operators import resample as RS
from spreadlens.operators.partials import Split, matrix
from spreadlens.plans import catalog


def test_no_text_is_shuffled_for_domains(spark, tmp_path):
    docs = [(1, "Law school", "en", "src1", 10), (1, "a film", "fr", "src2", 6), (2, None, "en", "src1", None), (None, "math", "en", "src1", 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = catalog.QUERIES["domain_canonical"](spark, str(tmp_path))
    assert sorted(r[:2] for r in found.collect()) == [(1, "Entertainment"), (1, "Entertainment"), (1, "Law & Business"), (1, "Law & Business"), (2, "Other")]
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in joined.split("Join")[0]  # what comes out of the join


def test_bootstrap_draws_by_id(spark):
    """Repeated and null ids, null groups and values, other classes: as the plain sums of one row a draw."""
    rows = [(k, None if i % 7 == 0 else f"i{i % 11}", None if i % 9 == 0 else i / 3, i % 3 if i % 8 else None) for i in range(60) for k in ("a", None)]
    df = spark.createDataFrame([*rows, ("one", "x", 1.0, 1)], "k string, id string, v double, y int").repartition(3)
    got = {r.k: r for r in RS.bootstrap_mean_diff(df, ["k"], "id", "v", "y", n_boot=30).collect()}
    w = RS.poisson_one(md5_uniform(F.lit(137), F.col("rep"), F.col("id")))
    drawn = df.where("v is not null and y is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("rep")).withColumn("w", w)
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("w") * F.col("v"))), F.sum(F.when(c, F.col("w"))))
    plain = drawn.groupBy("k", "rep").agg((mean(F.col("y") == 1) - mean(F.col("y") != 1)).alias("d")).where("d is not null and k = 'a'").collect()
    d = [r.d for r in plain]
    assert got["a"].n_replicates == len(d) == 30 and np.isclose(got["a"].p_value, np.mean(np.array(d) <= 0))
    assert np.allclose([got["a"].ci_low, got["a"].ci_high], np.quantile(d, [0.025, 0.975]))
    assert got["one"].n_replicates == 0 and got["one"].n_pos == 1 and got["one"].n_neg == 0
    assert RS.bootstrap_mean_diff(df, [], "id", "v", "y", n_boot=5).count() == 1
    # a row is handed over once, not once a replicate
    assert "sequence(1, 30" not in RS.bootstrap_mean_diff(df, ["k"], "id", "v", "y", n_boot=30)._jdf.queryExecution().optimizedPlan().toString()


def test_passes_read_no_strings(spark):
    df = spark.createDataFrame([(f"r{i}", float(i % 5), int(i % 3 == 0), str(i % 4) if i % 5 else None) for i in range(40)], "id string, a double, y int, fold string")
    splits = [Split("fold", "0"), Split("fold", ("1", "2"), True)]
    rows = matrix(df, "id", "y", ["a"], ["fold"])
    packed = BL.Packed(rows, splits, 1, ["fold"])
    assert {t for _, t in packed.rows.dtypes} == {"binary"}
    got = packed.summed(lambda x, y, trains: np.array([len(x), x.sum(), y.sum(), *[trains[s].sum() for s in splits]]))
    want = df.agg(F.count("*"), F.sum("a"), F.sum("y"), F.sum((~F.coalesce(F.col("fold") == "0", F.lit(False))).cast("int")),
                  F.sum(F.coalesce(F.col("fold").isin("1", "2"), F.lit(False)).cast("int"))).first()
    assert got.tolist() == [float(v) for v in want]
    assert BL.Packed(rows.limit(0), splits, 1, ["fold"]).summed(lambda x, y, trains: x.sum(0)) is None
