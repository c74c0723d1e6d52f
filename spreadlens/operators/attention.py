"""Attention-graph features.

Input is the long attention table ``(id, layer, head, i, j, a)``; a
response's attention map is lower-triangular, so the Laplacian of each
head is triangular and its eigenvalues are its diagonal — a plain
aggregate, no eigensolver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def laplacian_diagonal(att: DataFrame) -> DataFrame:
    """``λ_j = Σ_i a_ij / max(T − j, 1) − a_jj`` per (id, layer, head, j)."""
    tlen = att.groupBy("id").agg((F.max("i") + 1).alias("T"))
    col = att.groupBy("id", "layer", "head", "j").agg(
        F.sum("a").alias("col_sum"), F.max(F.when(F.col("i") == F.col("j"), F.col("a"))).alias("a_jj"))
    x = col.join(tlen, "id")
    d = F.col("col_sum") / F.greatest(F.col("T") - F.col("j"), F.lit(1))
    return x.select("id", "layer", "head", "j", (d - F.coalesce("a_jj", F.lit(0.0))).alias("eig"), "T")


def top_k_eigenvalues(lap: DataFrame, k: int = 10) -> DataFrame:
    """The ``min(k, T)`` largest eigenvalues per (id, layer, head), rank 1 = largest.

    The window partition is one head of one response (T rows), and Spark
    applies the ``rank <= k`` limit before the shuffle.
    """
    w = Window.partitionBy("id", "layer", "head").orderBy(F.col("eig").desc(), F.col("j"))
    return (lap.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("id", "layer", "head", "rank", "eig"))


def attention_score(att: DataFrame) -> DataFrame:
    """Mean over tokens of ``ln(max(a_jj, 1e-10))`` per (id, layer, head)."""
    return (att.where(F.col("i") == F.col("j"))
            .groupBy("id", "layer", "head")
            .agg(F.avg(F.log(F.greatest(F.col("a"), F.lit(1e-10)))).alias("attention_score")))


def eigen_column_name(layer, head, rank):
    return F.format_string("eig_l%d_h%d_k%d", layer, head, rank)


def eigen_wide(eig: DataFrame, names: list[str]) -> DataFrame:
    """I4: long → wide ``eig_l{l}_h{h}_k{r}`` (names listed so the pivot needs no extra job)."""
    return (eig.withColumn("name", eigen_column_name(F.col("layer"), F.col("head"), F.col("rank")))
            .groupBy("id").pivot("name", names).agg(F.first("eig")))


def eigen_long_from_wide(wide: DataFrame, names: list[str]) -> DataFrame:
    """I4: wide → long, parsing layer/head/rank back from the column name."""
    long = wide.unpivot(["id"], names, "name", "eig")
    parts = F.regexp_extract_all("name", F.lit(r"(\d+)"), 1)
    return long.select("id", parts[0].cast("int").alias("layer"), parts[1].cast("int").alias("head"),
                       parts[2].cast("int").alias("rank"), "eig")


def eigen_names(layers: int, heads: int, ranks: int) -> list[str]:
    return [f"eig_l{l}_h{h}_k{r}" for l in range(layers) for h in range(heads) for r in range(1, ranks + 1)]


def eigen_vectors(eig: DataFrame, layers: int, heads: int, ranks: int) -> DataFrame:
    """``(id, features array<double>, complete)`` in (layer, head, rank) order.

    Every sample stays.  ``complete`` says whether it has all layers × heads
    × min(ranks, its own number of ranks) values; a short sequence (T < k) is
    complete with fewer ranks.
    """
    pos = (F.col("layer") * heads + F.col("head")) * ranks + (F.col("rank") - 1)
    v = (eig.groupBy("id")
         .agg(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.col("eig").alias("v")))),
                          lambda z: z["v"]).alias("features"),
              F.least(F.max("rank"), F.lit(ranks)).alias("_k")))
    return v.select("id", "features", (F.size("features") == F.col("_k") * (layers * heads)).alias("complete"))


def whole_vectors(vec: DataFrame, size: int) -> DataFrame:
    """``(id, features)`` for a fit that needs vectors of one size; another size is an error, not a dropped row."""
    return vec.select("id", F.when(F.size("features") == size, F.col("features")).otherwise(F.raise_error(
        F.concat(F.lit(f"expected {size} values for id "), F.col("id")))).alias("features"))


def head_mean(eig: DataFrame) -> DataFrame:
    """Average the heads of each (id, layer, rank): L·H·k values become L·k."""
    return eig.groupBy("id", "layer", "rank").agg(F.avg("eig").alias("mean_eig"))


def family_means(eig: DataFrame, family: str) -> DataFrame:
    """Per-sample means over a column family of the eigen table.

    ``rank`` → mean per (id, rank); ``layer`` → per (id, layer);
    ``layer_head`` → per (id, layer, head); ``lambda_max`` → mean of rank 1.
    """
    if family == "lambda_max":
        return eig.where(F.col("rank") == 1).groupBy("id").agg(F.avg("eig").alias("lambda_max_mean"))
    by = {"rank": ["rank"], "layer": ["layer"], "layer_head": ["layer", "head"]}[family]
    return eig.groupBy("id", *by).agg(F.avg("eig").alias("mean_eig"))


def top_of_top(eig: DataFrame, keep: int) -> DataFrame:
    """Keep the first ``keep`` ranks of each head's top-k list."""
    return eig.where(F.col("rank") <= keep)
