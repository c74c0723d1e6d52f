import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from spreadlens.operators.ranking import average_ranks, dense_ranks, prefix_sums, row_numbers, slice_bounds, slice_number


def test_prefix_sums_match_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c"]), rnd.randint(0, 40) / 4.0, rnd.randint(1, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, c int").groupBy("k", "v").agg(F.sum("c").alias("c"))
    got = prefix_sums(df, ["k"], ["v"], {"cum": F.col("c")}, rows_per_slice=7)
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("cum_ref", F.sum("c").over(w))
    bad = got.join(exp, ["k", "v"]).where(F.col("cum") != F.col("cum_ref")).count()
    assert bad == 0
    assert got.count() == df.count()


def test_prefix_sums_descending_and_global(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(50)], "v double, c int")
    got = {r.v: r.cum for r in prefix_sums(df, [], ["v"], {"cum": F.col("c")}, descending=True, rows_per_slice=5).collect()}
    assert got[49.0] == 1 and got[0.0] == 50


def test_row_numbers_and_dense_ranks(spark):
    df = spark.createDataFrame([("x", "b", 1), ("x", "a", 2), ("y", "a", 3), ("x", "b", 4)], "k string, s string, i int")
    rn = {r.i: r.rn for r in row_numbers(df, ["k"], ["s", "i"], "rn").collect()}
    assert rn == {2: 1, 1: 2, 4: 3, 3: 1}
    dr = {r.i: r.drank for r in dense_ranks(df, [], "s").collect()}
    assert dr == {1: 2, 2: 1, 3: 1, 4: 2}


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 1), (3.0, 3)], "v double, c long")
    got = {r.v: r.avg_rank for r in average_ranks(df, [], "v", "c").collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0}


def test_common_prefixes_and_ties_are_split(spark):
    rows = [(f"Brand#{i % 400:05d}", i) for i in range(4000)] + [("Brand#00007", i) for i in range(4000, 8000)]
    df = spark.createDataFrame(rows, "s string, i int")
    bounds = slice_bounds(df, ["s", "i"], 200)
    assert 30 <= len(bounds) <= 40
    sizes = [r["count"] for r in df.groupBy(slice_number(df, ["s", "i"], bounds).alias("n")).count().collect()]
    assert len(sizes) >= 30 and max(sizes) < 900
    got = row_numbers(df, [], ["s", "i"], "rn", rows_per_slice=200)
    assert [r.i for r in got.orderBy("rn").collect()] == [i for _, i in sorted(rows)]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_many_bounds_and_null_keys(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "k", float(i) if i % 10 else None) for i in range(1000)], "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    got = prefix_sums(counts, ["k"], ["v"], {"cum": F.col("c")}, rows_per_slice=5)
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    exp = counts.withColumn("cum", F.sum("c").over(w))
    assert sorted(map(str, got.select("k", "v", "cum").collect())) == sorted(map(str, exp.select("k", "v", "cum").collect()))
