"""Stand-in inputs derived from the driver tables (see FIXTURES.md §3).

Each function is a lazy plan over the given Parquet tables, so its work
grows with them.  The same derivations are written as SQL CTEs in
``spreadlens.plans.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import md5_int, md5_uniform
from ..functions.text import VALID_DOMAINS, tokens
from ..functions.vectors import l2_normalize
from .tables import read_table

TEXT_DIMS = 64
#: Characters whose words a task holds at once.
PIECE_CHARS = 8 << 20


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 responses: one document = one sampled answer; question = (source, lang)."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    u = md5_uniform(F.lit("resp"), F.col("doc_id"))
    correctness = (F.when(F.col("quality") == 1, "correct")
                   .when(F.col("quality") == 0, "incorrect")
                   .when(u < 0.40, "correct").when(u < 0.70, "incorrect")
                   .when(u < 0.90, "refused").when(u < 0.95, "error")
                   .otherwise("unknown"))
    domains = F.array(*[F.lit(d) for d in VALID_DOMAINS])
    prompt_id = F.concat_ws("_", "source", "lang")
    return (docs.join(labels, "doc_id", "left")
            .select(
                F.concat_ws("_", prompt_id, F.col("doc_id").cast("string")).alias("id"),
                prompt_id.alias("prompt_id"),
                F.col("doc_id"),
                F.concat(F.lit("ds"), (F.substring("source", 4, 10).cast("int") % 5).cast("string")).alias("dataset"),
                F.col("lang").alias("topic_label"),
                F.concat(F.lit("Which passage comes from "), F.col("source"), F.lit(" in "), F.col("lang"),
                         F.lit("?")).alias("question"),
                F.col("source").alias("reference_answer"),
                F.col("text").alias("model_answer"),
                F.lit(1.0).alias("temperature"),
                F.col("lang").alias("type"),
                F.element_at(domains, (md5_int(F.lit("dom"), F.col("doc_id")) % 5 + 1).cast("int")).alias("domain"),
                correctness.alias("correctness"),
                F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("adversarial"),
                (md5_int(F.lit("score"), F.col("doc_id")) % 5 + 1).cast("int").alias("correctness_score"),
                F.length("text").alias("answer_len"),
            ))


def _hashed_bow(dims: int):
    """Arrow-batched helper: whole text → L2-normalised hashed bag of words.

    Tokens are the lower-cased runs of Unicode letters and digits; a token's
    bucket is the first 7 hex digits of its md5 modulo ``dims`` (the same
    value DuckDB computes).  A batch is worked off in pieces of about
    ``PIECE_CHARS`` characters, whatever the number and length of its texts; tokens of a piece
    are factorised so md5 runs once per distinct token, and counts come from one ``bincount``.  Texts
    without tokens, null included, give the zero vector.  The UDF is marked non-deterministic only so the
    optimiser does not duplicate it into a pushed-down filter.
    """
    word = re.compile(r"[^\W_]+")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out, piece, held = [], [], 0
        for t in texts:
            piece.append(t)
            held += len(t) if isinstance(t, str) else 0
            if held > PIECE_CHARS:
                out += vectors(piece)
                piece, held = [], 0
        return pd.Series(out + vectors(piece), dtype=object)

    def vectors(texts: list) -> list:
        lists = [word.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
        lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = list(itertools.chain.from_iterable(lists))
        n = len(lists)
        if not flat:
            return [[0.0] * dims] * n
        codes, uniq = pd.factorize(np.asarray(flat, dtype=object))
        hashed = np.fromiter((int(hashlib.md5(u.encode("utf-8")).hexdigest()[:7], 16) % dims for u in uniq),
                             dtype=np.int64, count=len(uniq))
        doc = np.repeat(np.arange(n, dtype=np.int64), lens)
        counts = np.bincount(doc * dims + hashed[codes], minlength=n * dims).reshape(n, dims).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        vecs = counts / np.maximum(norms, 1e-12)[:, None]
        return list(vecs)

    return embed.asNondeterministic()


def text_vectors(resp: DataFrame, dims: int = TEXT_DIMS) -> DataFrame:
    """G15 (re-aimed): hashed bag-of-words embedding of the whole answer text.

    A narrow, per-row map (no shuffle): each response's vector depends on
    its own text only.  Output: ``id, e array<double>``, one row per response.
    """
    return resp.select("id", _hashed_bow(dims)(F.col("model_answer")).alias("e"))


def text_vectors_sql(resp: DataFrame, dims: int = TEXT_DIMS) -> DataFrame:
    """The same embedding with built-in expressions only (explode + two aggregations)."""
    tok = resp.select("id", F.explode_outer(tokens("model_answer")).alias("t"))
    counts = (tok.groupBy("id", F.coalesce((md5_int("t") % dims).cast("int"), F.lit(0)).alias("b"))
              .agg(F.count("t").cast("double").alias("c")))
    dense = (counts.groupBy("id")
             .agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
             .select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                       lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v")))
    return dense.select("id", l2_normalize("v").alias("e"))


def text_cloud(spark: SparkSession, sf_dir: str, dims: int = TEXT_DIMS) -> DataFrame:
    """Responses with their text vectors: ``dataset, prompt_id, id, e``."""
    resp = responses(spark, sf_dir)
    return resp.select("dataset", "prompt_id", "id", _hashed_bow(dims)(F.col("model_answer")).alias("e"))


def dense_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense unit vectors grouped into questions by their label."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select(
        F.concat(F.lit("ds"), (F.col("label") % 3).cast("string")).alias("dataset"),
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("prompt_id"),
        F.col("vec_id").cast("string").alias("id"),
        l2_normalize(F.col("embedding")).alias("e"))


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature rows: dataset = line status, y = returned."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_id"),
        F.col("l_linestatus").alias("dataset"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"))


LINEITEM_FEATURES = ["quantity", "extendedprice", "discount", "tax"]


def feature_long(rows: DataFrame, features: list[str], id_cols: list[str]) -> DataFrame:
    """Unpivot wide feature columns to ``(..., feature, value)`` (I4 direction long)."""
    return rows.unpivot(id_cols, features, "feature", "value").withColumn("value", F.col("value").cast("double"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with ties: ``row_id, dataset, y_true, y_prob``."""
    rows = lineitem_rows(spark, sf_dir)
    u = md5_uniform(F.lit("pred"), F.col("row_id"))
    return rows.select("row_id", "dataset", F.col("y").alias("y_true"),
                       F.round((u + F.col("y")) / 2.0, 3).alias("y_prob"))


def eigen_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 long eigen table: 64 values = 4 layers × 4 heads × 4 ranks."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    x = emb.select("vec_id", "label", F.posexplode("embedding").alias("pos", "eig"))
    return x.select(
        F.col("vec_id").cast("string").alias("id"),
        F.concat(F.lit("ds"), (F.col("label") % 3).cast("string")).alias("dataset"),
        (F.col("label") >= 5).cast("int").alias("label"),
        (F.col("pos") / 16).cast("int").alias("layer"),
        ((F.col("pos") % 16) / 4).cast("int").alias("head"),
        (F.col("pos") % 4 + 1).cast("int").alias("rank"),
        F.col("eig").cast("double").alias("eig"))


ATTN_T = 8      # tokens per sequence
ATTN_SLICES = 4  # 2 layers × 2 heads, 16 dims each


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 attention table ``(id, layer, head, i, j, a)``, lower-triangular rows summing to 1.

    Consecutive vectors form sequences of ``ATTN_T`` tokens; head ``s`` uses
    the 16-dim slice ``s`` of the vectors; a = causal softmax of 4·dot.
    """
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    tok = emb.select((F.col("vec_id") / ATTN_T).cast("long").alias("seq"),
                     (F.col("vec_id") % ATTN_T).cast("int").alias("pos"), "embedding")
    qi = tok.select("seq", F.col("pos").alias("i"), F.col("embedding").alias("q"))
    kj = tok.select("seq", F.col("pos").alias("j"), F.col("embedding").alias("k"))
    pairs = qi.join(kj, "seq").where(F.col("j") <= F.col("i"))
    heads = pairs.select("seq", "i", "j", "q", "k", F.explode(F.sequence(F.lit(0), F.lit(ATTN_SLICES - 1))).alias("s"))
    logit = F.aggregate(F.sequence(F.col("s") * 16, F.col("s") * 16 + 15), F.lit(0.0),
                        lambda acc, d: acc + (F.element_at("q", d + 1) * F.element_at("k", d + 1)).cast("double"))
    scored = heads.select("seq", "s", "i", "j", F.exp(4.0 * logit).alias("w"))
    from pyspark.sql import Window
    w = Window.partitionBy("seq", "s", "i")
    return scored.select(
        F.concat(F.lit("seq"), F.col("seq").cast("string")).alias("id"),
        (F.col("s") / 2).cast("int").alias("layer"),
        (F.col("s") % 2).cast("int").alias("head"),
        "i", "j", (F.col("w") / F.sum("w").over(w)).alias("a"))


def attention_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sequence metadata: ``id, dataset, label`` (label = mean vector class ≥ 4.5)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    seq = (F.col("vec_id") / ATTN_T).cast("long")
    return (emb.groupBy(seq.alias("seq")).agg(F.avg("label").alias("m"))
            .select(F.concat(F.lit("seq"), F.col("seq").cast("string")).alias("id"),
                    F.concat(F.lit("ds"), (F.col("seq") % 3).cast("string")).alias("dataset"),
                    (F.col("m") >= 4.5).cast("int").alias("label")))


def judge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies as JSON text, including malformed and partial ones."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    word = (F.when(F.col("event_type") == "click", "Correct")
            .when(F.col("event_type") == "view", "INCORRECT").otherwise("refused"))
    full = F.concat(F.lit('{"correctness": "'), word, F.lit('", "domain": "STEM", "adversarial": '),
                    F.when(F.col("value") > 10, "true").otherwise("false"),
                    F.lit(', "correctness_score": '), ((k % 5) + 1).cast("string"), F.lit("}"))
    content = (F.when(F.col("event_type") == "error",
                      F.lit('{"correctness": "incorrect", "domain": "STEM", "adversarial": tru'))
               .when(F.col("event_type") == "signup",
                     F.concat(F.lit('{"domain": "Humanities", "correctness_score": '), k.cast("string"), F.lit("}")))
               .when(F.col("event_id") % 97 == 0, F.lit('{"correctness": "correct", "adversarial": "true", "correctness_score": "4"}'))
               .when(F.col("event_id") % 89 == 0, F.lit('{"correctness": null, "domain": "STEM", "correctness_score": 4.0}'))
               .when(F.col("event_id") % 83 == 0, F.lit('["correct"]'))
               .otherwise(full))
    return ev.select(F.col("event_id").alias("id"), content.alias("content"))


def paraphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10 paraphrase rows: answer = brand, question = part name, domain = part type."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    return part.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("answer"),
                       F.col("p_name").alias("question"), F.col("p_type").alias("domain"))


def raw_benchmarks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Rows in the own columns of eight benchmarks, from parts and benchmark items."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    question = F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("question")
    items = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return {
        "gsm8k": items.select(F.col("text").alias("question"), F.concat(F.lit("first 1 + 1\n#### "), F.col("item_id").cast("string"), F.lit(" ")).alias("answer")),
        "nq_open": part.select(question, F.array("p_brand", "p_type").alias("answer")),
        "truthfulqa": part.select(question, F.col("p_brand").alias("best_answer"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("category")),
        "triviaqa": part.select(question, F.struct(F.col("p_brand").alias("value")).alias("answer")),
        "defan": part.select(question, F.col("p_brand").alias("answer"), F.col("p_type").alias("type"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("domain")),
        "mmlu": part.select(question, F.array("p_brand", "p_type", "p_name", F.lit("none")).alias("choices"), (F.col("p_size") % 4).cast("int").alias("answer"),
                            F.col("p_type").alias("subject")),
        "math": part.select(question.alias("problem"), F.concat(F.lit("so \\boxed{"), F.col("p_size").cast("string"), F.lit("} holds")).alias("solution"),
                            F.col("p_type").alias("type")),
        "halueval": part.select(F.col("p_type").alias("knowledge"), question, F.col("p_brand").alias("right_answer")),
    }


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, text)``: turns as they are, and with the marks that answers of benchmarks carry."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    head = F.split_part("text", F.lit(" "), F.lit(1))
    marks = F.array(F.col("text"), F.concat("text", F.lit("\n#### "), head, F.lit(" \n")), F.concat(F.lit("so \\boxed{"), head, F.lit("} and \\boxed{2}")),
                    F.concat(F.lit("\n "), head, F.lit(" Question: "), F.col("text")))
    return conv.select("conv_id", "turn", F.posexplode(marks).alias("form", "text"))
