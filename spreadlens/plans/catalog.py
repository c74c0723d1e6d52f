"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver tables (or fixtures Spark derives from them)
in full.  Double columns are rounded to 6 decimals at the very end so the
DuckDB cross-check compares stable values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.core import correlation, md5_int, md5_uniform, stars
from ..functions.vectors import flat_index_parts, norm, signed_log1p
from ..operators import attention as A
from ..operators import geometry as G
from ..operators import hypothesis as H
from ..operators import metrics as M
from ..operators import resample as RS
from ..operators import rollup as R
from ..operators.ranking import dense_ranks, row_numbers
from ..sources import fixtures as FX
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# ------------------------------------------------------------------ shared plans

def question_table(spark, sf) -> DataFrame:
    """E1 + E4/E5 + G1–G4 per question of the text cloud (SQL-checkable part of G12)."""
    resp = FX.responses(spark, sf).drop("model_answer").checkpoint()
    counts = R.question_counts(resp)
    meta = R.question_metadata(resp).select("prompt_id", "dataset", F.col("domain_mode").alias("domain"),
                                            "domain_inconsistent", "adversarial")
    # rounded, so that values that are equal but for the order of summation tie in every rank
    geo = G.cloud_dispersion(FX.text_cloud(spark, sf), ["prompt_id"]).select("prompt_id", *[F.round(c, 9).alias(c) for c in GEO])
    return meta.join(counts, "prompt_id").join(geo, "prompt_id")


GEO = G.GEOMETRY_COLS


# ------------------------------------------------------------------ A: sources

@query("responses_loaded")
def q_responses_loaded(spark, sf):
    """Responses with derived prompt_id/answer_len and the embedding-count check."""
    resp = FX.responses(spark, sf)
    vec = FX.text_vectors(resp)
    has_vec = resp.join(vec.select("id", F.lit(True).alias("has_vector")), "id", "left")
    return rounded(has_vec.select(
        "id", TX.prompt_id_from_id("id").alias("prompt_id"), "dataset", "domain", "correctness",
        "adversarial", "correctness_score", "answer_len",
        F.coalesce("has_vector", F.lit(False)).alias("has_vector")))


@query("responses_jsonl")
def q_responses_jsonl(spark, sf):
    """Responses appended as JSON lines to the shared folder, and loaded with derived columns."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.tables import append_rows, load_responses
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/responses-{uuid.uuid4().hex}.jsonl"
    resp = FX.responses(spark, sf)
    append_rows(resp.select("id", "dataset", "question", "model_answer", "type", "domain", "correctness", "adversarial", "correctness_score"), path)
    got = load_responses(spark, path, ["id", "dataset", "correctness"])
    return got.select("id", "prompt_id", "dataset", "correctness", "adversarial", "correctness_score", "answer_len")


@query("vector_map")
def q_vector_map(spark, sf):
    """A10: id → vector maps written as JSON, every other one in a ``data`` wrapper, loaded and joined to metadata."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.tables import load_vector_map
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    emb = read_table(spark, sf, "embeddings", ["vec_id", "label", "embedding"])
    block = F.floor(F.col("vec_id") / 1024)
    entry = F.struct(F.col("vec_id").cast("string").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    maps = (emb.where(F.col("embedding").isNotNull()).groupBy(block.alias("block"))
            .agg(F.map_from_entries(F.collect_list(entry)).alias("m")))
    text = F.when(F.col("block") % 2 == 0, F.to_json("m")).otherwise(F.to_json(F.struct(F.col("m").alias("data"))))
    maps.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = load_vector_map(spark, path).withColumn("vec_id", F.col("id").cast("bigint"))
    x = got.join(emb.select("vec_id", "label"), "vec_id")
    return rounded(x.select("vec_id", "label", F.size("vec").cast("bigint").alias("n"),
                            F.aggregate("vec", F.lit(0.0), lambda a, v: a + v).alias("total"), norm("vec").alias("norm")))


@query("union_datasets")
def q_union(spark, sf):
    """Vertical concat of per-source frames with missing columns filled."""
    from ..sources.tables import union_all
    resp = FX.responses(spark, sf)
    a = resp.where(F.col("dataset") == "ds0").select("id", "dataset", "answer_len")
    b = resp.where(F.col("dataset") != "ds0").select("id", "dataset", "correctness")
    return union_all([a, b])


# ------------------------------------------------------------------ B: scalar functions

@query("domain_canonical")
def q_domain_canonical(spark, sf):
    """B1 over whole document texts and over the judge-domain labels."""
    # both are found before the join, so that no text is shuffled
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", TX.consolidate_domain("text").alias("text_domain"))
    resp = FX.responses(spark, sf).select("doc_id", TX.consolidate_domain("domain").alias("label_domain"))
    return docs.join(resp, "doc_id").select("doc_id", "text_domain", "label_domain")


@query("answer_extract")
def q_answer_extract(spark, sf):
    """B2/B3/B4 over whole conversation texts, plain and with the marks of benchmark answers."""
    conv = FX.answer_texts(spark, sf)
    return conv.select("conv_id", "turn", "form", F.md5(TX.extract_boxed("text")).alias("boxed_md5"),
                       F.md5(TX.extract_after_hashes("text")).alias("hashes_md5"),
                       TX.clean_answer("text").alias("clean"))


@query("prompt_render")
def q_prompt_render(spark, sf):
    """Generation and judge prompts per response."""
    resp = FX.responses(spark, sf)
    family = F.when(F.col("topic_label") == "en", "mmlu").when(F.col("topic_label") == "fr", "math").otherwise("factual")
    choices = F.array("reference_answer", "topic_label", "dataset", "domain")
    return resp.select("id", F.md5(TX.render_prompt(family, F.col("question"), choices)).alias("prompt_md5"),
                       F.md5(TX.render_judge_prompt("question", "reference_answer", "model_answer")).alias("judge_md5"),
                       TX.defan_only(F.when(F.col("dataset") == "ds0", "defan").otherwise(F.col("dataset")),
                                     F.col("type")).alias("type_field"))


@query("judge_parse")
def q_judge_parse(spark, sf):
    """Judge JSON normalisation with parse failures as error rows."""
    raw = FX.judge_raw(spark, sf)
    p = TX.parse_judgement("content")
    return raw.select("id", *[v.alias(k) for k, v in p.items()])


@query("judge_binary")
def q_judge_binary(spark, sf):
    """0/1 judgement (empty answer ⇒ 1; 0 only when label == 0)."""
    ev = read_table(spark, sf, "events", ["event_id", "event_type", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    content = F.concat(F.lit('{"label": '), (k % 2).cast("string"), F.lit("}"))
    answer = F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("event_type"))
    return ev.select("event_id", TX.binary_judgement(answer, content).alias("label"))


@query("identity_keys")
def q_identity(spark, sf):
    """Dense per-dataset question index and zero-padded answer ids."""
    resp = FX.responses(spark, sf).select("dataset", "prompt_id", "doc_id", "temperature")
    qidx = dense_ranks(resp, ["dataset"], "prompt_id", "qi")
    ans = row_numbers(qidx, ["prompt_id"], ["doc_id"], "ai")
    pid = TX.prompt_identity("dataset", F.col("qi") - 1, "temperature")
    return ans.select("doc_id", pid.alias("new_prompt_id"),
                      TX.answer_identity(pid, F.col("ai") - 1).alias("new_id"),
                      TX.sample_label(F.col("ai") - 1).alias("sample_num"))


@query("pending_rows")
def q_pending(spark, sf):
    """Rows still to judge (score missing or −1) and the binary class label."""
    raw = FX.judge_raw(spark, sf)
    p = TX.parse_judgement("content")
    parsed = raw.select("id", p["correctness"].alias("correctness"), p["correctness_score"].alias("score"))
    pending = parsed.where(F.col("score").isNull() | F.col("score").isin(-1))
    judged = parsed.where(F.col("correctness") != "error").select(
        "id", (F.lower("correctness") == "incorrect").cast("int").alias("label"))
    return pending.select("id", F.lit(None).cast("int").alias("label"), F.lit(True).alias("pending")) \
        .unionByName(judged.withColumn("pending", F.lit(False)))


@query("p_hat_bands")
def q_bands(spark, sf):
    """p_hat bands of both notebooks."""
    c = R.question_counts(FX.responses(spark, sf))
    p = F.col("p_halluc")
    return rounded(c.select("prompt_id", "p_halluc",
                            F.when(p < 0.2, "low").when((p > 0.3) & (p <= 0.6), "mid").when(p >= 0.9, "high")
                            .alias("band_a"),
                            F.when(p < 0.4, "low").when(p <= 0.65, "mid").otherwise("high").alias("band_b")))


@query("vector_ops")
def q_vector_ops(spark, sf):
    """Norms, normalisation, cosine to the next vector, signed log1p."""
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    from ..functions.vectors import cosine, l2_normalize
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    x = emb.join(nxt, "vec_id", "left")
    return rounded(x.select("vec_id", norm("embedding").alias("norm"),
                            norm(l2_normalize("embedding")).alias("unit_norm"),
                            cosine("embedding", "nxt").alias("cos_next"),
                            F.aggregate(signed_log1p("embedding"), F.lit(0.0), lambda a, v: a + v).alias("slog_sum")))


@query("eigen_index")
def q_eigen_index(spark, sf):
    """Flat position → (layer, head, rank)."""
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    x = emb.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    parts = flat_index_parts("pos", 4, 4)
    return rounded(x.select("vec_id", "pos", *[v.alias(k) for k, v in parts.items()], F.col("v").cast("double").alias("v")))


# ------------------------------------------------------------------ C: joins

@query("join_eigen_meta")
def q_join_eigen_meta(spark, sf):
    """Eigen vectors ⋈ metadata on id, size-checked (L·H·k)."""
    eig = FX.eigen_long(spark, sf)
    vec = A.eigen_vectors(eig, 4, 4, 4)
    meta = eig.select("id", "dataset", "label").distinct()
    return rounded(vec.join(meta, "id").select("id", "dataset", "label", F.size("features").alias("dim"),
                                               F.element_at("features", 1).alias("f_first"),
                                               F.element_at("features", -1).alias("f_last")))


@query("join_question_geometry")
def q_join_geo(spark, sf):
    """C2/G12 (checkable part): question counts ⋈ geometry on prompt_id."""
    return rounded(question_table(spark, sf))


@query("join_targets_left")
def q_targets_left(spark, sf):
    """Class features left-joined to class targets."""
    para = FX.paraphrase(spark, sf)
    feats = para.groupBy(F.col("answer").alias("class_id")).agg(F.countDistinct("domain").alias("n_domains"))
    targets = R.group_target(para.withColumn("wrong", F.col("domain") == "ECONOMY"),
                             "answer", "wrong", k=20).withColumnRenamed("answer", "class_id")
    return rounded(feats.join(targets.where(F.col("n_wrong") > 10), "class_id", "left"))


@query("resume_anti")
def q_resume(spark, sf):
    """C4: rows not yet processed (left anti join on id), duplicates dropped."""
    resp = FX.responses(spark, sf)
    done = read_table(spark, sf, "labels", ["doc_id"]).dropDuplicates(["doc_id"])
    return resp.join(done, "doc_id", "left_anti").select("id", "prompt_id")


@query("semi_selected")
def q_semi(spark, sf):
    """Rows whose answer has exactly n distinct questions (semi join)."""
    para = FX.paraphrase(spark, sf)
    sel = R.answers_with_n_questions(para, "answer", "question", 47)
    return para.join(sel.select("answer"), "answer", "left_semi").select("row_id", "answer", "question")


@query("lookup_majority_domain")
def q_lookup(spark, sf):
    """Majority over whitelisted domains per question, joined back (null if none)."""
    resp = FX.responses(spark, sf)
    # failed judgements carry no domain of the whitelist
    resp = resp.withColumn("domain", F.when(F.col("correctness").isin("error", "unknown"), "N/A").otherwise(F.col("domain")))
    valid = resp.where(F.col("domain").isin(TX.VALID_DOMAINS))
    maj = R.mode(valid, ["question"], "domain", "clean_domain")
    return resp.select("id", "question").join(maj, "question", "left").select("id", "clean_domain")


@query("upsert_judgements")
def q_upsert(spark, sf):
    """Upsert of new judgements into the full state (left join + coalesce)."""
    resp = FX.responses(spark, sf).select("id", "correctness", "correctness_score", "answer_len")
    new = (resp.where(F.col("correctness").isin("error", "unknown"))
           .select("id", F.when(F.col("answer_len") % 2 == 0, "correct").otherwise("incorrect").alias("new_c"),
                   F.lit(3).alias("new_s")))
    up = resp.join(new, "id", "left")
    return up.select("id", F.coalesce("new_c", "correctness").alias("correctness"),
                     F.coalesce("new_s", "correctness_score").alias("correctness_score"))


@query("matched_pairs_corr")
def q_matched(spark, sf):
    """The same questions under two embeddings, Pearson and Spearman of D_cos."""
    resp = FX.responses(spark, sf)
    base = resp.select("dataset", "prompt_id", "id")
    a = G.cloud_dispersion(base.join(FX.text_vectors(resp, 64), "id"), ["prompt_id"]).select("prompt_id", F.round("D_cos", 9).alias("a"))
    b = G.cloud_dispersion(base.join(FX.text_vectors(resp, 32), "id"), ["prompt_id"]).select("prompt_id", F.round("D_cos", 9).alias("b"))
    j = a.join(b, "prompt_id")
    return rounded(spearman_pearson(j, "a", "b", "prompt_id"))


def spearman_pearson(df: DataFrame, a: str, b: str, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks) between two columns."""
    from ..operators.ranking import average_ranks
    keys = keys or []
    ranks = []
    for c in (a, b):
        cnt = df.groupBy(*keys, F.col(c).alias("_val")).agg(F.count(F.lit(1)).alias("_c"))
        r = average_ranks(cnt, keys, "_val", "_c").select(*keys, F.col("_val").alias(c), F.col("avg_rank").alias(f"_r_{c}"))
        ranks.append(r)
    x = df.join(ranks[0], keys + [a]).join(ranks[1], keys + [b])
    return x.groupBy(*keys).agg(correlation(a, b).alias("pearson"), correlation(f"_r_{a}", f"_r_{b}").alias("spearman"),
                                F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ E: roll-ups

@query("question_metadata")
def q_meta(spark, sf):
    """Per-question metadata with domain mode (ties → smallest)."""
    return R.question_metadata(FX.responses(spark, sf))


@query("question_counts")
def q_counts(spark, sf):
    """Counts, fractions, rates, label, score/length moments."""
    return rounded(R.question_counts(FX.responses(spark, sf)))


@query("skipped_questions")
def q_skipped(spark, sf):
    """All-refused questions and their counts by domain."""
    resp = FX.responses(spark, sf)
    lab = F.when(F.col("quality").isNull(), "refused").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    docs = read_table(spark, sf, "documents", ["doc_id", "lang", "source"])
    labels = read_table(spark, sf, "labels", ["doc_id", "quality"])
    alt = (docs.join(labels, "doc_id", "left").select(
        F.concat_ws("_", "source", "lang").alias("prompt_id"), lab.alias("correctness"), "lang",
        F.lit(3).alias("correctness_score"), F.lit(1).alias("answer_len"), F.col("lang").alias("domain")))
    sk = R.skipped_questions(alt)
    return R.skipped_by_domain(sk)


@query("questions_per_domain")
def q_qpd(spark, sf):
    """E8."""
    return R.questions_per_domain(FX.responses(spark, sf))


@query("split_domains")
def q_split(spark, sf):
    """E9 on the question table (domain = mode)."""
    return R.split_domains(question_table(spark, sf), 15)


@query("loading_summary")
def q_loading(spark, sf):
    """Rows, questions, samples-per-question min/max/median, domains."""
    return rounded(R.loading_summary(FX.responses(spark, sf)))


@query("label_distribution")
def q_label_dist(spark, sf):
    """Label distribution in percent."""
    return rounded(R.label_distribution(FX.responses(spark, sf)))


@query("domain_consistency")
def q_consistency(spark, sf):
    """E11."""
    return rounded(R.domain_consistency(R.question_metadata(FX.responses(spark, sf))))


@query("filtering_diagnostic")
def q_filtering(spark, sf):
    """E12."""
    resp = FX.responses(spark, sf)
    feat = question_table(spark, sf)
    return R.filtering_diagnostic(feat, R.question_metadata(resp), 15)


@query("crosstab_domain_correctness")
def q_crosstab(spark, sf):
    """Domain × correctness shares over the fixed label order."""
    return rounded(R.crosstab_share(FX.responses(spark, sf), "domain", "correctness", TX.LABEL_ORDER))


@query("label_fractions_by_domain")
def q_fracs(spark, sf):
    """E14."""
    return rounded(R.label_fractions_by(question_table(spark, sf), "domain"))


@query("non_correct_rate")
def q_noncorrect(spark, sf):
    """E15."""
    return rounded(R.non_correct_rate(FX.responses(spark, sf)))


@query("describe_lineitem")
def q_describe(spark, sf):
    """Describe with exact quartiles, per dataset, over all line items."""
    rows = FX.lineitem_rows(spark, sf)
    return rounded(R.describe(rows, FX.LINEITEM_FEATURES, ["dataset"]))


@query("correlation_matrix")
def q_corr(spark, sf):
    """Pearson matrix of the line-item features plus the label."""
    rows = FX.lineitem_rows(spark, sf)
    return rounded(R.correlation_matrix(rows, FX.LINEITEM_FEATURES + ["y"]))


@query("spearman_lineitem")
def q_spearman(spark, sf):
    """Spearman and Pearson of quantity vs extended price, per dataset."""
    rows = FX.lineitem_rows(spark, sf)
    return rounded(spearman_pearson(rows, "quantity", "extendedprice", "row_id", ["dataset"]))


@query("group_target")
def q_group_target(spark, sf):
    """n_wrong, n, p_hat, y = n_wrong ≥ 8 per question."""
    resp = FX.responses(spark, sf).withColumn("wrong", F.col("correctness") != "correct")
    return rounded(R.group_target(resp, "prompt_id", "wrong", 8))


@query("group_size_histogram")
def q_hist_sizes(spark, sf):
    """E20."""
    return R.group_size_histogram(FX.paraphrase(spark, sf), "answer")


@query("p_hat_question_domain")
def q_phat_qd(spark, sf):
    """p_hat per (question, domain)."""
    resp = FX.responses(spark, sf)
    return rounded(resp.groupBy("question", "domain").agg(
        F.avg((F.col("correctness") != "correct").cast("double")).alias("p_hat")))


@query("lambda_max_mean")
def q_lmax(spark, sf):
    """Mean rank-1 eigenvalue per sample."""
    return rounded(A.family_means(FX.eigen_long(spark, sf), "lambda_max"))


@query("head_topk_mean")
def q_head_mean(spark, sf):
    """Mean of the top-k eigenvalues per (sample, layer, head)."""
    return rounded(A.family_means(FX.eigen_long(spark, sf), "layer_head"))


@query("uniform_group_size")
def q_uniform(spark, sf):
    """E26."""
    return R.uniform_group_size(FX.responses(spark, sf), "prompt_id")


@query("pooled_by_dataset")
def q_pooled(spark, sf):
    """GROUPING SETS ((dataset), ()) with a Pooled row."""
    feat = R.question_counts(FX.responses(spark, sf)).join(
        FX.responses(spark, sf).select("prompt_id", "dataset").distinct(), "prompt_id")
    return rounded(R.pooled_and_by(feat, "dataset", [F.count(F.lit(1)).alias("n_questions"),
                                                     F.avg("label").alias("rate")]))


@query("pivot_auc")
def q_pivot(spark, sf):
    """Dataset × feature AUC table, pivoted."""
    long = FX.feature_long(FX.lineitem_rows(spark, sf), FX.LINEITEM_FEATURES, ["dataset", "y"])
    a = M.feature_auc(long, ["dataset"], "y")
    return rounded(a.groupBy("dataset").pivot("feature", FX.LINEITEM_FEATURES).agg(F.first("auc")))


# ------------------------------------------------------------------ F: windows / top-k / sampling

@query("paraphrase_classes")
def q_classes(spark, sf):
    """class ids C%04d over sorted distinct answers, question_in_class."""
    para = FX.paraphrase(spark, sf)
    cls = dense_ranks(para, [], "answer", "_k")
    cls = cls.withColumn("class_id", F.format_string("C%04d", F.col("_k").cast("int")))
    q = row_numbers(cls, ["class_id"], ["question", "row_id"], "question_in_class")
    return q.select("row_id", "class_id", "question_in_class")


@query("first_row")
def q_first(spark, sf):
    """first response per question (by id)."""
    resp = FX.responses(spark, sf)
    return resp.groupBy("prompt_id").agg(F.min_by("id", "id").alias("first_id"),
                                         F.min_by("correctness", "id").alias("first_correctness"))


@query("best_feature")
def q_best(spark, sf):
    """best feature by AUC per dataset (argmax)."""
    long = FX.feature_long(FX.lineitem_rows(spark, sf), FX.LINEITEM_FEATURES, ["dataset", "y"])
    a = M.feature_auc(long, ["dataset"], "y")
    return rounded(a.groupBy("dataset").agg(F.max_by("feature", F.struct("auc", "feature")).alias("best_feature"),
                                            F.max("auc").alias("best_auc")))


@query("top_questions")
def q_top(spark, sf):
    """three most dispersed questions per dataset (window group limit)."""
    from pyspark.sql import Window
    qt = question_table(spark, sf)
    w = Window.partitionBy("dataset").orderBy(F.col("D_cos").desc(), F.col("prompt_id"))
    return rounded(qt.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 3)
                   .select("dataset", "prompt_id", "D_cos", "rk"))


@query("stratified_sample")
def q_strat(spark, sf):
    """F8: seeded sample of 3 rows per domain (md5 order)."""
    from pyspark.sql import Window
    resp = FX.responses(spark, sf)
    w = Window.partitionBy("domain").orderBy(md5_int(F.lit(7), F.col("id")), F.col("id"))
    return resp.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 3).select("domain", "id", "rk")


@query("quota_allocation")
def q_quota(spark, sf):
    """quota per domain for a target of 100 groups."""
    para = FX.paraphrase(spark, sf)
    counts = para.groupBy("domain").agg(F.countDistinct("answer").alias("n_groups"))
    return R.quota_allocation(counts, "domain", "n_groups", 100)


@query("ordered_feature_union")
def q_union_feats(spark, sf):
    """The 4 features most correlated with the label, then the KS-significant ones in feature order."""
    qt = question_table(spark, sf).checkpoint()
    feats = GEO + ["score_mean", "len_mean"]
    return R.ordered_feature_union(qt, feats, "label", H.ks_tests(
        FX.feature_long(qt, feats, ["label"]), ["feature"], n_tests=len(feats)), 4)


# ------------------------------------------------------------------ G: geometry

@query("text_dispersion")
def q_text_disp(spark, sf):
    """G1–G4 on the text cloud (moment kernel, exact)."""
    return rounded(G.cloud_dispersion(FX.text_cloud(spark, sf), ["prompt_id"]))


@query("dense_dispersion")
def q_dense_disp(spark, sf):
    """G1–G4 on the dense cloud."""
    return rounded(G.cloud_dispersion(FX.dense_cloud(spark, sf), ["prompt_id"]))


@query("dense_centroid_builtin")
def q_dense_centroid(spark, sf):
    """G1/G3 with built-in aggregates only."""
    return rounded(G.centroid_dispersion(FX.dense_cloud(spark, sf), ["prompt_id"]))


@query("text_structure")
def q_text_struct(spark, sf):
    """G5–G11 on the text cloud at τ = 0.85."""
    return rounded(G.cloud_structure(FX.text_cloud(spark, sf), ["prompt_id"], tau=0.85))


@query("dense_structure")
def q_dense_struct(spark, sf):
    """G5–G11 on the dense cloud at τ = 0.2."""
    return rounded(G.cloud_structure(FX.dense_cloud(spark, sf), ["prompt_id"], tau=0.2))


@query("question_features")
def q_question_features(spark, sf):
    """G12 + G13: the full per-question feature row."""
    from .features import question_features
    return rounded(question_features(FX.responses(spark, sf), FX.text_cloud(spark, sf)))


# ------------------------------------------------------------------ I: attention

@query("laplacian_diagonal")
def q_lap(spark, sf):
    """I1."""
    return rounded(A.laplacian_diagonal(FX.attention(spark, sf)))


@query("laplacian_topk")
def q_topk(spark, sf):
    """Top-4 eigenvalues per (sample, layer, head)."""
    return rounded(A.top_k_eigenvalues(A.laplacian_diagonal(FX.attention(spark, sf)), 4))


@query("attention_score")
def q_attscore(spark, sf):
    """I3."""
    return rounded(A.attention_score(FX.attention(spark, sf)))


@query("eigen_wide")
def q_eigen_wide(spark, sf):
    """I4: long → wide eig_l_h_k columns."""
    names = A.eigen_names(4, 4, 4)
    return rounded(A.eigen_wide(FX.eigen_long(spark, sf), names))


@query("attention_training_set")
def q_att_train(spark, sf):
    """Top-k Laplacian features + attention score joined to labels."""
    att = FX.attention(spark, sf)
    top = A.top_k_eigenvalues(A.laplacian_diagonal(att), 4)
    vec = A.eigen_vectors(top, 2, 2, 4)
    score = A.attention_score(att).groupBy("id").agg(F.avg("attention_score").alias("mean_attention_score"))
    lab = FX.attention_labels(spark, sf)
    return rounded(vec.join(score, "id").join(lab, "id").select(
        "id", "dataset", "label", F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("feature_sum"),
        "mean_attention_score"))


# ------------------------------------------------------------------ H: statistics

def lineitem_long(spark, sf):
    return FX.feature_long(FX.lineitem_rows(spark, sf), FX.LINEITEM_FEATURES, ["dataset", "row_id", "y"]) \
        .withColumnRenamed("y", "label")


@query("ks_lineitem")
def q_ks(spark, sf):
    """H1 per (dataset, feature) with Bonferroni over the features."""
    return rounded(H.ks_tests(lineitem_long(spark, sf), ["dataset", "feature"], n_tests=len(FX.LINEITEM_FEATURES)))


@query("ks_questions")
def q_ks_q(spark, sf):
    """H1 on the question table's geometric features."""
    qt = question_table(spark, sf)
    long = FX.feature_long(qt, GEO, ["prompt_id", "label"])
    return rounded(H.ks_tests(long, ["feature"], n_tests=len(GEO)))


@query("mann_whitney_heads")
def q_mwu(spark, sf):
    """H6: per (dataset, layer, head) MWU on the mean top-k eigenvalue."""
    eig = FX.eigen_long(spark, sf)
    per = eig.groupBy("id", "dataset", "label", "layer", "head").agg(F.avg("eig").alias("value"))
    return rounded(H.mann_whitney(per, ["dataset", "layer", "head"]))


@query("significant_heads")
def q_sig_heads(spark, sf):
    """H7: share of heads with p < 0.05 per dataset; one dataset holds a single class, and its heads count too."""
    eig = FX.eigen_long(spark, sf)
    eig = eig.unionByName(eig.where(F.col("label") == 1).withColumn("dataset", F.lit("OneClass")))
    per = eig.groupBy("id", "dataset", "label", "layer", "head").agg(F.avg("eig").alias("value"))
    return rounded(H.significant_share(H.mann_whitney(per, ["dataset", "layer", "head"]), ["dataset"]))


@query("cohens_d_rank")
def q_cohen(spark, sf):
    """H8: Cohen's d per eigen rank."""
    return rounded(H.cohens_d(FX.eigen_long(spark, sf), ["rank"], "eig", "label"))


@query("kde_lineitem")
def q_kde(spark, sf):
    """H9: Gaussian KDE of the discount per (dataset, label), 50-point grid."""
    rows = FX.lineitem_rows(spark, sf)
    return rounded(H.kde_grid(rows, ["dataset", "y"], "discount", grid=50))


@query("histogram_lineitem")
def q_hist(spark, sf):
    """40-bin histogram of extended price by label."""
    rows = FX.lineitem_rows(spark, sf)
    return rounded(H.histogram(rows, ["dataset"], "extendedprice", 40, by="y"))


@query("permutation_test")
def q_perm(spark, sf):
    """H2: one-sided permutation test of D_cos by label per dataset (10,000 permutations)."""
    qt = question_table(spark, sf)
    return rounded(RS.permutation_test(qt, ["dataset"], "prompt_id", "D_cos", "label"))


@query("bootstrap_mean_diff")
def q_boot(spark, sf):
    """H4/H5: pooled + per-dataset bootstrap of the λ_max gap (1,000 replicates), with a dataset of one class."""
    eig = FX.eigen_long(spark, sf)
    lm = A.family_means(eig, "lambda_max").join(eig.select("id", "dataset", "label").distinct(), "id")
    pooled = lm.withColumn("dataset", F.lit("Pooled"))
    both = lm.unionByName(pooled).unionByName(lm.where(F.col("label") == 1).withColumn("dataset", F.lit("OneClass")))
    return rounded(RS.bootstrap_mean_diff(both, ["dataset"], "id", "lambda_max_mean", "label"))


# ------------------------------------------------------------------ J: metrics

@query("auc_by_dataset")
def q_auc(spark, sf):
    """Exact AUC and AP of the scored line items per dataset."""
    p = FX.predictions(spark, sf)
    both = M.ranked_counts(p, ["dataset"], "y_prob", "y_true").groupBy("dataset").agg(
        F.max("n1").alias("n1"), F.max("n0").alias("n0"), M._auc().alias("auc"), M._ap().alias("average_precision"))
    return rounded(both)


@query("roc_points")
def q_roc(spark, sf):
    """ROC/PR points at every distinct threshold."""
    return rounded(M.curve_points(FX.predictions(spark, sf), ["dataset"], "y_prob", "y_true"))


@query("classification_metrics")
def q_clf_metrics(spark, sf):
    """AUC, AP, Brier and metrics at 0.5."""
    return rounded(M.classification_metrics(FX.predictions(spark, sf), ["dataset"], "y_prob", "y_true"))


@query("threshold_table")
def q_thr(spark, sf):
    """Threshold table with confusion counts."""
    return rounded(M.threshold_table(FX.predictions(spark, sf), ["dataset"], "y_prob", "y_true"))


@query("calibration_bins")
def q_calib(spark, sf):
    """J7."""
    return rounded(M.calibration_bins(FX.predictions(spark, sf), ["dataset"], "y_prob", "y_true"))


@query("feature_auc")
def q_feat_auc(spark, sf):
    """Each question feature used as a score."""
    qt = question_table(spark, sf)
    long = FX.feature_long(qt, GEO + ["score_mean", "len_mean"], ["prompt_id", "label"])
    return rounded(M.feature_auc(long, [], "label"))


# ------------------------------------------------------------------ M: models (rows-only checks unless noted)

LI = FX.LINEITEM_FEATURES


@query("standardize_lineitem")
def q_standardize(spark, sf):
    """M1: population z-scores (constant → 0)."""
    from ..operators.models import standardize
    rows = FX.lineitem_rows(spark, sf)
    return rounded(standardize(rows, LI).select("row_id", *[c + "_z" for c in LI]))


@query("stratified_split")
def q_split(spark, sf):
    """M3: md5-seeded stratified 80/20 split."""
    from ..operators.models import stratified_split
    return stratified_split(FX.lineitem_rows(spark, sf), "row_id", "y", 0.2, 42).select("row_id", "y", "is_test")


@query("stratified_folds")
def q_folds(spark, sf):
    """M4: md5-seeded stratified 5 folds."""
    from ..operators.models import stratified_folds
    return stratified_folds(FX.lineitem_rows(spark, sf), "row_id", "y", 5, 42).select("row_id", "y", "fold")


@query("logistic_holdout")
def q_logistic(spark, sf):
    """M5: L2 logistic models on the line items' hold-out split, plain and with balanced classes."""
    return rounded(_lineitem_holdout(spark, sf, [(0.0, False), (0.0, True)]))


@query("elastic_net_holdout")
def q_elastic(spark, sf):
    """M5: elastic-net logistic models (l1 ratio 0.5 and 0.25) on the same split, plain and with balanced classes."""
    return rounded(_lineitem_holdout(spark, sf, [(r, b) for r in (0.5, 0.25) for b in (False, True)]))


def _lineitem_holdout(spark, sf, settings):
    from ..operators import batch_linear as BL
    from ..operators.models import stratified_split
    from ..operators.partials import Split, matrix
    sp = stratified_split(FX.lineitem_rows(spark, sf), "row_id", "y", 0.2, 42)
    rows = matrix(sp.withColumn("part", F.when(F.col("is_test"), "test").otherwise("train")), "row_id", "y", LI, ["part"])
    models = [BL.Linear((str(r), str(b).lower()), tuple(range(len(LI))), Split("part", "test"), l1_ratio=r, balanced=b) for r, b in settings]
    keys = ["l1_ratio", "balanced"]
    return M.classification_metrics(BL.fit(rows, models, len(LI), ["part"]).scores(rows, keys), keys, "p", "y")


def _grid(spark, sf, task):
    from . import modelling as ML
    return ML.grid_scores(spark, sf).where(F.col("task") == task)


def _holdout(spark, sf, classifiers):
    x = _grid(spark, sf, "holdout").where(F.col("classifier").isin(classifiers))
    return rounded(M.classification_metrics(x, ["classifier"], "p", "y"))


@query("forest_holdout")
def q_forest(spark, sf):
    """M6: forests of 200 trees of depth 6 and of 600 trees without a depth limit (two rows a leaf), on the question table."""
    return _holdout(spark, sf, ["random_forest", "random_forest_leaf"])


@query("boosting_holdout")
def q_boosting(spark, sf):
    """M7: 100 boosting rounds of depth 3 and 200 of depth 4, on the question table."""
    return _holdout(spark, sf, ["gradient_boosting", "boosted_trees"])


@query("adaboost_auc")
def q_ada(spark, sf):
    """M9: AdaBoost of 300 stumps, on the question table."""
    return _holdout(spark, sf, ["adaboost"])


@query("svm_platt_auc")
def q_svm(spark, sf):
    """M8: linear support vector machine with sigmoid calibration (mean of three calibrated fits): all hold-out metrics."""
    from ..functions.core import md5_int as draw
    from ..operators import batch_linear as BL
    from ..operators.models import stratified_split
    from ..operators.partials import matrix
    sp = stratified_split(FX.lineitem_rows(spark, sf), "row_id", "y", 0.2, 42)
    sp = sp.withColumn("cell", F.when(F.col("is_test"), "test").otherwise((draw(F.lit("cell"), F.col("row_id")) % 3).cast("string")))
    rows = matrix(sp, "row_id", "y", LI, ["cell"])
    pred = BL.calibrated_margins(rows, ("svm",), ["classifier"], tuple(range(len(LI))), len(LI), "cell", "test", ["0", "1", "2"], ["cell"])
    return rounded(M.classification_metrics(pred, ["classifier"], "p", "y"))


@query("cv_model_selection")
def q_cv(spark, sf):
    """Out-of-fold AUC and AP (mean, deviation) and rank of all five classifiers over 5 folds, on the six features."""
    from . import modelling as ML
    from pyspark.sql import Window
    x = ML.selection(_grid(spark, sf, "cv").where("variant = 'All 6 geometric'"), ["classifier"])
    # one row a classifier
    return rounded(x.withColumn("rank", F.row_number().over(Window.orderBy(F.col("auc_mean").desc(), "classifier"))))


@query("out_of_fold_bundle")
def q_oof_bundle(spark, sf):
    """Metrics, thresholds, curve and predictions of the out-of-fold scores of the logistic model on the six features."""
    from . import modelling as ML
    return rounded(ML.bundle(_grid(spark, sf, "cv").where("variant = 'All 6 geometric' and classifier = 'logistic'").select("id", "y", "p")))


@query("final_evaluation")
def q_final(spark, sf):
    """The whole bundle of the logistic model on the hold-out split: metrics, thresholds, curve, predictions, coefficients."""
    from . import modelling as ML
    pred = _grid(spark, sf, "holdout").where("classifier = 'logistic'").select("id", "y", "p")
    return rounded(ML.bundle(pred, ML.holdout_coefficients(spark, sf)))


@query("classifier_bakeoff")
def q_bakeoff(spark, sf):
    """The five pipelines on principal components of the eigen vectors, on one split: AUC, accuracy and the rest."""
    from . import modelling as ML
    return rounded(M.classification_metrics(ML.bakeoff_scores(spark, sf), ["classifier"], "p", "y"))


@query("feature_ablation")
def q_ablation(spark, sf):
    """The eight feature sets x five classifiers, 5-fold out-of-fold AUC and AP."""
    from . import modelling as ML
    return rounded(ML.selection(_grid(spark, sf, "cv"), ["variant", "classifier"]))


@query("ablation_pivot")
def q_ablation_pivot(spark, sf):
    """Feature set x classifier table of the out-of-fold AUC."""
    from . import modelling as ML
    x = ML.selection(_grid(spark, sf, "cv"), ["variant", "classifier"])
    return rounded(x.groupBy("variant").pivot("classifier", ML.CLASSIFIERS).agg(F.first("auc_mean")))


@query("per_domain_clf")
def q_per_domain(spark, sf):
    """Every classifier cross-validated inside each domain, min(5, smallest class) folds; one-class domains are skipped."""
    from . import modelling as ML
    x = ML.selection(_grid(spark, sf, "domain").withColumnRenamed("variant", "domain"), ["domain", "classifier"])
    n = ML.question_rows(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n_questions"))
    return rounded(x.join(n, "domain"))


@query("per_domain_pivot")
def q_per_domain_pivot(spark, sf):
    """Domain x classifier table of the AUC inside each domain."""
    from . import modelling as ML
    x = ML.selection(_grid(spark, sf, "domain").withColumnRenamed("variant", "domain"), ["domain", "classifier"])
    return rounded(x.groupBy("domain").pivot("classifier", ML.CLASSIFIERS).agg(F.first("auc_mean")))


@query("leave_one_dataset_out")
def q_lobo(spark, sf):
    """Trained on all datasets but one and tested on it: train AUC, test AUC, AP and F1 of four feature sets x five classifiers."""
    x = _grid(spark, sf, "lobo").withColumnRenamed("held", "held_out")
    keys = ["held_out", "variant", "classifier"]
    test = M.classification_metrics(x.where("not trained"), keys, "p", "y").select(
        *keys, F.col("roc_auc").alias("test_auc"), F.col("average_precision").alias("test_ap"), F.col("f1_at_0_5").alias("test_f1"))
    train = M.auc(x.where("trained"), keys, "p", "y").select(*keys, F.col("auc").alias("train_auc"), (F.col("n1") + F.col("n0")).alias("n_train"))
    n = x.where("not trained").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"))
    return rounded(train.join(test, keys).join(n, keys))


@query("transfer_matrix")
def q_transfer(spark, sf):
    """Logistic model trained on one dataset, AUC on each (the diagonal is in-sample)."""
    x = _grid(spark, sf, "transfer").join(_datasets(spark, sf), "id")
    return rounded(M.auc(x, ["held", "dataset"], "p", "y").select(F.col("held").alias("train"), F.col("dataset").alias("test"), "n1", "n0", "auc",
                                                               (F.col("held") == F.col("dataset")).alias("in_sample")))


@query("transfer_pivot")
def q_transfer_pivot(spark, sf):
    """Train x test table of the transfer AUC."""
    x = M.auc(_grid(spark, sf, "transfer").join(_datasets(spark, sf), "id"), ["held", "dataset"], "p", "y")
    names = [r[0] for r in _datasets(spark, sf).select("dataset").distinct().orderBy("dataset").limit(1000).collect()]
    return rounded(x.groupBy(F.col("held").alias("train")).pivot("dataset", names).agg(F.first("auc")))


def _datasets(spark, sf):
    from . import modelling as ML
    return ML.question_rows(spark, sf).where("dataset is not null").select(F.col("row_id").alias("id"), "dataset")


@query("layerwise_probe")
def q_layer_probe(spark, sf):
    """Probe AUC per layer vs all layers (eigen vectors), on one split."""
    from ..operators.models import probe_eval, probe_split
    eig = FX.eigen_long(spark, sf).checkpoint()
    labels = eig.select("id", "label").distinct()
    split = probe_split(labels).checkpoint()
    layers = [r[0] for r in eig.select("layer").distinct().orderBy("layer").collect()]
    out = None
    for layer in [None, *layers]:
        e = eig if layer is None else eig.where(F.col("layer") == layer).withColumn("layer", F.lit(0))
        n = len(layers) if layer is None else 1
        r = probe_eval(A.eigen_vectors(e, n, 4, 4), labels, 4, n * 16, split).withColumn("layer", F.lit("all" if layer is None else str(layer)))
        out = r if out is None else out.unionByName(r)
    return rounded(out)


@query("topk_vs_baseline")
def q_topk_baseline(spark, sf):
    """Top-4 vs top-2 Laplacian features vs the attention-score baseline, all on the test rows of one split."""
    from ..operators.models import probe_eval, probe_split
    att = FX.attention(spark, sf).checkpoint()
    lab = FX.attention_labels(spark, sf).select("id", "label")
    # sequences shorter than the others have fewer eigenvalues a head: no probe can read them, so no variant counts them
    top = A.top_k_eigenvalues(A.laplacian_diagonal(att), 4).checkpoint()
    whole = A.eigen_vectors(top, 2, 2, 4).where(F.size("features") == 16).select("id")
    lab = lab.join(whole, "id", "left_semi").checkpoint()
    split = probe_split(lab).checkpoint()
    top = top.join(whole, "id", "left_semi")
    r4 = probe_eval(A.eigen_vectors(top, 2, 2, 4), lab, 4, 16, split).withColumn("variant", F.lit("top4"))
    r2 = probe_eval(A.eigen_vectors(A.top_of_top(top, 2), 2, 2, 2), lab, 4, 8, split).withColumn("variant", F.lit("top2"))
    score = (A.attention_score(att).groupBy("id").agg(F.avg("attention_score").alias("s"))
             .join(split.where("is_test").select("id", F.col("label").cast("int").alias("label")), "id"))
    base = M.auc(score, [], "s", "label").withColumn("variant", F.lit("attention_score"))
    return rounded(r4.unionByName(r2).unionByName(base))


@query("grid_search")
def q_grid(spark, sf):
    """2-fold AUC of the whole grid (components, whitening, penalty, C, l1 ratio, class weight) on the eigen vectors, best first."""
    from . import modelling as ML
    keys = ["components", "whiten", "penalty", "c", "l1_ratio", "balanced"]
    x = M.auc(ML.search_scores(spark, sf), [*keys, "held"], "p", "y")
    return rounded(x.groupBy(*keys).agg(F.avg("auc").alias("cv_auc"), F.stddev_pop("auc").alias("cv_auc_std")))


@query("two_sampling_transfer")
def q_two_sampling(spark, sf):
    """Features of the same questions from two embeddings; in-domain on held-out questions, and both directions."""
    from ..operators.models import impute_median, sampling_transfer
    resp = FX.responses(spark, sf)
    counts = R.question_counts(resp).select("prompt_id", "label")
    base = resp.select("prompt_id", "id")
    a, b = (impute_median(G.cloud_dispersion(base.join(FX.text_vectors(resp, d), "id"), ["prompt_id"]).join(counts, "prompt_id").checkpoint(), GEO)
            for d in (64, 32))
    return rounded(sampling_transfer(a, b, GEO, "label", "logistic", "prompt_id", ("64", "32")))


@query("permutation_importance")
def q_importance(spark, sf):
    """Fall of the hold-out AUC when a feature's values are dealt anew (3 repeats)."""
    from ..operators.models import permutation_importance
    return rounded(permutation_importance(FX.lineitem_rows(spark, sf), LI, "y", "row_id", repeats=3))


@query("linear_attribution")
def q_attr(spark, sf):
    """Mean |contribution| per feature of a logistic model."""
    from ..operators.models import linear_attribution
    contrib = linear_attribution(FX.lineitem_rows(spark, sf), LI, "y", "row_id")
    return rounded(contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution")))


@query("pca_variance")
def q_pca(spark, sf):
    """M2: explained variance of 8 principal components of the eigen vectors."""
    from ..operators.models import pca_variance
    vec = A.eigen_vectors(FX.eigen_long(spark, sf), 4, 4, 4).select("id", F.col("features").alias("v"))
    return rounded(pca_variance(vec, "v", 8))


@query("bootstrap_oob_auc")
def q_boot_auc(spark, sf):
    """H3: mean and 95 % interval of the out-of-bag AUC of forests over 2,000 bootstrap replicates of the question table."""
    from . import modelling as ML
    from ..operators.models import auc_interval, bootstrap_oob_auc
    return rounded(auc_interval(bootstrap_oob_auc(ML.question_rows(spark, sf), ML.BASE, "label", "row_id")))


# ------------------------------------------------------------------ W: streaming (batch form)

@query("daily_error_rate")
def q_daily(spark, sf):
    """W2 batch form: daily tumbling windows of events, error rate per event day and user bucket."""
    from ..streaming.intake import window_rates_batch
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    ev = ev.withColumn("user_bucket", (F.col("user_id") % 4).cast("int"))
    return rounded(window_rates_batch(ev, "user_bucket", F.col("event_type") == "error"))


@query("dedup_events")
def q_dedup(spark, sf):
    """W1 batch form: events with duplicate ids removed (first by time)."""
    ev = read_table(spark, sf, "events", ["event_id", "ts", "event_type"])
    return ev.groupBy("event_id").agg(F.min("ts").alias("ts"), F.min_by("event_type", "ts").alias("event_type"))


# ------------------------------------------------------------------ G16–G18, H12, N1

@query("embedding_2d")
def q_2d(spark, sf):
    """PCA 2-D projection of the dense vectors (rows-only: component signs are arbitrary)."""
    return rounded(G.project_2d(FX.dense_cloud(spark, sf)))


def _signed_points(spark, sf) -> DataFrame:
    """The dense vectors, whole, in two dimensions: projected by seeded signs (SQL can follow these, unlike principal axes)."""
    return G.sign_projection(FX.dense_cloud(spark, sf), 64).select("prompt_id", "id", "z1", "z2")


@query("embedding_3d_whitened")
def q_3d(spark, sf):
    """Whitened projection on three principal axes; its means are 0, its variances 1 (components have any sign)."""
    from ..operators import wide_pca
    cloud = FX.dense_cloud(spark, sf)
    z = wide_pca.fit(cloud, "e", 3).project(cloud, "e", whiten=True)
    return rounded(z.select("id", F.posexplode("z").alias("axis", "z")).groupBy("axis").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.round(F.avg("z"), 6)).alias("mean"), F.round(F.var_samp("z"), 4).alias("variance")))


@query("hull_area_2d")
def q_hull(spark, sf):
    """Convex-hull area per question in the signed projection of the whole vectors."""
    return rounded(G.hull_area(_signed_points(spark, sf), ["prompt_id"], bucket_rows=16))


@query("domain_median_centroid")
def q_median_centroid(spark, sf):
    """Per-group median of both coordinates of the signed projection, groups with ≥ 5 points."""
    pts = _signed_points(spark, sf)
    out = None
    for c in ("z1", "z2"):
        cnt = pts.groupBy("prompt_id", c).agg(F.count(F.lit(1)).alias("_c"))
        med = R.median_from_counts(cnt, ["prompt_id"], c, "_c").withColumnRenamed("median", f"median_{c}")
        out = med if out is None else out.join(med, "prompt_id")
    n = pts.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(out.join(n, "prompt_id").where(F.col("n") >= 5))


@query("density_peak_2d")
def q_peak(spark, sf):
    """2-D KDE peak per question (20×20 grid, bandwidth 0.25) in the signed projection."""
    return rounded(G.density_peak(_signed_points(spark, sf), ["prompt_id"], "z1", "z2", grid=20, bandwidth=0.25))


@query("projection_2d_views")
def q_projection_views(spark, sf):
    """G16 → G17/G18/H12: hull area, median centroid and density peak of each question in the projection of the whole vectors."""
    pts = G.project_2d(FX.dense_cloud(spark, sf)).checkpoint()
    hull = G.hull_area(pts, ["prompt_id"])
    peak = G.density_peak(pts, ["prompt_id"], "z1", "z2", grid=20, bandwidth=0.25)
    out = hull.join(peak, "prompt_id")
    for c in ("z1", "z2"):
        cnt = pts.groupBy("prompt_id", c).agg(F.count(F.lit(1)).alias("_c"))
        out = out.join(R.median_from_counts(cnt, ["prompt_id"], c, "_c").withColumnRenamed("median", f"median_{c}"), "prompt_id")
    return rounded(out)


@query("graph_spectrum_moments")
def q_spectrum_moments(spark, sf):
    """Σλ and Σλ² of every question's similarity graph (the sums of degrees and of squared entries)."""
    return rounded(G.cloud_structure(FX.dense_cloud(spark, sf), ["prompt_id"], tau=0.2, moments=True).select("prompt_id", *G.MOMENT_COLS))


@query("sequential_blocks")
def q_blocks(spark, sf):
    """Features of fixed blocks of responses."""
    from .features import block_features
    cloud = FX.dense_cloud(spark, sf).withColumn("block", F.concat_ws("-", "prompt_id", (F.col("id").cast("long") % 3).cast("string"))).checkpoint()
    return rounded(block_features(cloud, "block", tau=0.2))


@query("family_means_by_rank_and_layer")
def q_families(spark, sf):
    """Means by rank and by layer."""
    eig = FX.eigen_long(spark, sf)
    parts = [A.family_means(eig, f).select("id", F.lit(f).alias("family"), F.col(f).alias("place"), "mean_eig") for f in ("rank", "layer")]
    return rounded(parts[0].unionByName(parts[1]))


@query("head_average")
def q_head_average(spark, sf):
    """Eigenvalues averaged over the heads of each layer."""
    return rounded(A.head_mean(FX.eigen_long(spark, sf)))


@query("eigen_long_again")
def q_eigen_long(spark, sf):
    """I4: long → wide → long."""
    names = A.eigen_names(4, 4, 4)
    return rounded(A.eigen_long_from_wide(A.eigen_wide(FX.eigen_long(spark, sf), names), names))


@query("flipped_permutation")
def q_flipped(spark, sf):
    """One-sided permutation test of a measure that falls for bad answers, with its sign flipped."""
    qt = question_table(spark, sf).withColumn("neg", -F.col("D_pair"))
    return rounded(RS.permutation_test(qt, ["dataset"], "prompt_id", "neg", "label"))


@query("residual_domain")
def q_residual(spark, sf):
    """Majority domain of each question; questions without a valid one get the residual domain."""
    resp = FX.responses(spark, sf).withColumn("domain", F.when(F.col("doc_id") % 3 == 0, F.col("domain")).otherwise("N/A"))
    maj = R.mode(resp.where(F.col("domain").isin(TX.VALID_DOMAINS)), ["question"], "domain", "clean")
    return resp.select("id", "question").join(maj, "question", "left").select("id", TX.residual_domain("clean").alias("domain_clean"))


@query("imputed_median")
def q_impute(spark, sf):
    """Missing tax entries become the median (an observed value)."""
    from ..operators.models import impute_median
    rows = FX.lineitem_rows(spark, sf).select("row_id", F.when(F.col("quantity") > 25, F.col("tax")).alias("tax"))
    return rounded(impute_median(rows, ["tax"]))


@query("crosstab_type_correctness")
def q_crosstab_type(spark, sf):
    """Type × correctness shares."""
    return rounded(R.crosstab_share(FX.responses(spark, sf), "type", "correctness", TX.LABEL_ORDER))


@query("dataset_feature_means")
def q_feature_means(spark, sf):
    """Per-dataset means of the label and the features."""
    return rounded(question_table(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(c).alias(c) for c in ["label", *GEO, "score_mean", "len_mean"]]))


@query("benchmark_questions")
def q_benchmarks(spark, sf):
    """Raw rows of eight benchmark formats in the common question form, a seeded subset of each."""
    from ..sources import benchmarks as B
    q = B.seeded_subset(B.all_questions(FX.raw_benchmarks(spark, sf)), "dataset", "question", 20, 42)
    return q.withColumn("choices", F.array_join("choices", "|"))


@query("mean_roc_folds")
def q_mean_roc(spark, sf):
    """Mean ROC over 5 md5 folds of the scored line items, at 100 false-positive rates."""
    p = FX.predictions(spark, sf).withColumn("fold", (md5_int(F.lit("fold"), F.col("row_id")) % 5).cast("int"))
    return rounded(M.mean_curve(p, ["dataset"], "fold", "y_prob", "y_true"))


@query("roc_band")
def q_roc_band(spark, sf):
    """Bootstrap band of the ROC of D_cos on the question table (200 replicates)."""
    return rounded(RS.bootstrap_roc_band(question_table(spark, sf), [], "prompt_id", "D_cos", "label"))


@query("preservation_ratio")
def q_preservation(spark, sf):
    """AUC of each line status against the pooled AUC of its own scores."""
    p = FX.predictions(spark, sf)
    noisy = p.withColumn("y_prob", F.round((F.col("y_prob") + md5_uniform(F.lit("noise"), F.col("row_id"))) / 2, 3))
    return rounded(M.transfer_ratio(M.auc(noisy, ["dataset"], "y_prob", "y_true").select("dataset", "auc"),
                                    M.auc(p, ["dataset"], "y_prob", "y_true").select("dataset", "auc"), ["dataset"]))


@query("entropy_vs_dispersion")
def q_scatter(spark, sf):
    """Semantic entropy, cosine dispersion and class of each question."""
    from . import modelling as ML
    q = ML.question_rows(spark, sf)
    return rounded(q.select("prompt_id", "H_sem", "D_cos", F.when(F.col("label") == 0, "Correct").otherwise("Hallucinated (incl. refused)").alias("group")))


@query("dispersion_scatter")
def q_dispersion_scatter(spark, sf):
    """N3, the part without clusters: cosine and pairwise dispersion and the class name of each question."""
    qt = question_table(spark, sf)
    return rounded(qt.select("prompt_id", "D_cos", "D_pair", F.when(F.col("label") == 0, "Correct").otherwise("Hallucinated (incl. refused)").alias("group")))


@query("pairplot_sample")
def q_pairplot(spark, sf):
    """At most 20 questions of each class in the order of a seeded hash, geometric features only."""
    return rounded(R.sample_per_class(question_table(spark, sf), "label", "prompt_id", 20, 42).select("prompt_id", "label", *GEO))


@query("results_summary")
def q_results(spark, sf):
    """The closing summary of each dataset, one row a dataset."""
    resp = FX.responses(spark, sf).drop("model_answer").checkpoint()
    qt = question_table(spark, sf).checkpoint()
    perm = RS.permutation_test(qt, ["dataset"], "prompt_id", "D_cos", "label")
    return rounded(R.results_summary(resp, qt, perm, TX.LABEL_ORDER, 15))


@query("describe_questions")
def q_describe_q(spark, sf):
    """E16 on the question table's geometric features."""
    return rounded(R.describe(question_table(spark, sf), GEO))


@query("stats_summary")
def q_stats_summary(spark, sf):
    """Per dataset: questions, hallucination rate, KS-significant features, best KS feature, δ, permutation p, AUC interval of D_cos (2,000 replicates)."""
    qt = question_table(spark, sf).checkpoint()
    long = FX.feature_long(qt, GEO, ["dataset", "prompt_id", "label"])
    ks = H.ks_tests(long, ["dataset", "feature"], n_tests=len(GEO))
    agg_ks = ks.groupBy("dataset").agg(F.sum(F.col("significant").cast("int")).alias("n_significant"),
                                       F.max_by("feature", F.struct("ks_stat", "feature")).alias("best_ks_feature"),
                                       F.max("ks_stat").alias("best_ks_stat"))
    base = qt.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_questions"), F.avg("label").alias("rate"))
    perm = RS.permutation_test(qt, ["dataset"], "prompt_id", "D_cos", "label").select("dataset", "delta", "p_value")
    boot = RS.bootstrap_auc(qt, ["dataset"], "prompt_id", "D_cos", "label")
    return rounded(base.join(agg_ks, "dataset", "left").join(perm, "dataset", "left").join(boot, "dataset", "left"))


@query("domain_stats")
def q_domain_stats(spark, sf):
    """Per-domain question count, hallucinated count, rate mean/std, mean H_sem."""
    from .features import question_features
    feat = question_features(FX.responses(spark, sf), FX.text_cloud(spark, sf))
    return rounded(R.domain_stats(feat))


@query("domain_counts")
def q_domain_counts(spark, sf):
    """E7, the part without clusters: per-domain questions, hallucinated ones, and their rate."""
    return rounded(question_table(spark, sf).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_questions"), F.sum("label").alias("n_hallucinated"), F.avg("label").alias("rate")))


@query("label_policies")
def q_label_policies(spark, sf):
    """§1 label rules side by side: merged, non-correct rate, k-of-n (k = 8)."""
    resp = FX.responses(spark, sf)
    merged = R.label_by_policy(resp, "merged").withColumnRenamed("label", "label_merged")
    rate = R.label_by_policy(resp, "non_correct_rate").withColumnRenamed("label", "non_correct_rate")
    kofn = R.label_by_policy(resp, "k_of_n", k=8).withColumnRenamed("label", "label_k_of_n")
    return rounded(rate.join(kofn, "prompt_id").join(merged, "prompt_id", "left"))
