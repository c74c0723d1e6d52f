"""Per-question and per-domain roll-ups (survey items E1–E27).

Every function is DataFrame-in / DataFrame-out and uses only aggregates with
partial (map-side) aggregation, so a hot question or domain is combined
across tasks instead of being gathered into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import correlation, md5_int, safe_div
from .ranking import prefix_sums

LABEL_POLICIES = ("merged", "response_incorrect", "non_correct_rate", "k_of_n")


def mode(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smallest value."""
    name = name or f"{value}_mode"
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(name))


def question_metadata(resp: DataFrame, domain_col: str = "domain", key: str = "prompt_id",
                      order_col: str = "id", include_type: bool = True) -> DataFrame:
    """First question/reference/dataset/adversarial, domain mode and consistency."""
    firsts = [F.min_by(c, order_col).alias(c) for c in ("question", "reference_answer", "dataset", "adversarial")]
    if include_type and "type" in resp.columns:
        firsts.append(F.min_by("type", order_col).alias("type"))
    base = resp.groupBy(key).agg(*firsts, F.countDistinct(domain_col).alias("n_unique_domains"))
    modes = mode(resp, [key], domain_col, "domain_mode")
    return (base.join(modes, key, "left")
            .withColumn("domain_inconsistent", F.col("n_unique_domains") > 1))


def question_counts(resp: DataFrame, key: str = "prompt_id", correctness: str = "correctness",
                    drop_all_refused: bool = True) -> DataFrame:
    """E4 + E5: label counts, fractions, rates and score/length moments per question.

    ``error`` and ``unknown`` rows count in ``n_samples`` only.  Questions with
    no correct and no incorrect answer are dropped (E6 reports them).
    """
    c = F.lower(F.col(correctness))
    agg = resp.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum((c == "correct").cast("int")).alias("n_correct"),
        F.sum((c == "incorrect").cast("int")).alias("n_incorrect"),
        F.sum((c == "refused").cast("int")).alias("n_refused"),
        F.avg("correctness_score").alias("score_mean"),
        F.stddev_pop("correctness_score").alias("score_std"),
        F.avg("answer_len").alias("len_mean"),
        F.stddev_pop("answer_len").alias("len_std"),
    )
    n = F.col("n_samples")
    out = (agg
           .withColumn("n_definitive", F.col("n_correct") + F.col("n_incorrect"))
           .withColumn("frac_correct", F.col("n_correct") / n)
           .withColumn("frac_incorrect", F.col("n_incorrect") / n)
           .withColumn("frac_refused", F.col("n_refused") / n)
           .withColumn("hall_rate_strict", F.when(F.col("n_definitive") > 0,
                                                  F.col("n_incorrect") / F.col("n_definitive")).otherwise(1.0))
           .withColumn("hall_rate_merged", (F.col("n_incorrect") + F.col("n_refused")) / n)
           .withColumn("p_halluc", F.col("hall_rate_merged"))
           .withColumn("label", (F.col("hall_rate_merged") > 0.5).cast("int")))
    if drop_all_refused:
        out = out.where(F.col("n_definitive") > 0)
    return out


def skipped_questions(resp: DataFrame, key: str = "prompt_id", domain_col: str = "domain") -> DataFrame:
    """All-refused questions (no correct, no incorrect) with their domain mode."""
    counts = question_counts(resp, key, drop_all_refused=False).where(F.col("n_definitive") == 0)
    modes = mode(resp, [key], domain_col, domain_col)
    return counts.join(modes, key, "left").select(key, domain_col, "n_refused", "n_samples")


def skipped_by_domain(skipped: DataFrame, domain_col: str = "domain") -> DataFrame:
    return skipped.groupBy(domain_col).agg(F.count(F.lit(1)).alias("n_skipped"))


def label_by_policy(resp: DataFrame, policy: str = "merged", key: str = "prompt_id",
                    k: int = 8) -> DataFrame:
    """The four label rules of the reference, as one parameter."""
    c = F.lower(F.col("correctness"))
    if policy == "merged":
        return question_counts(resp, key).select(key, "label")
    if policy == "response_incorrect":
        return resp.where(c != "error").select("id", key, (c == "incorrect").cast("int").alias("label"))
    if policy == "non_correct_rate":
        return resp.groupBy(key).agg(F.avg((c != "correct").cast("double")).alias("label"))
    if policy == "k_of_n":
        return resp.groupBy(key).agg((F.sum((c != "correct").cast("int")) >= k).cast("int").alias("label"))
    raise ValueError(f"unknown label policy {policy!r}; choose from {LABEL_POLICIES}")


def domain_stats(feat: DataFrame, rate_col: str = "hall_rate_merged", domain_col: str = "domain",
                 label_col: str = "label", entropy_col: str = "H_sem") -> DataFrame:
    """Questions, hallucinated count, rate mean/std (sample), mean entropy, percent."""
    return (feat.groupBy(domain_col).agg(
        F.count(label_col).alias("n_questions"),
        F.sum(label_col).alias("n_hallucinated"),
        F.avg(rate_col).alias("hall_rate_mean"),
        F.stddev_samp(rate_col).alias("hall_rate_std"),
        F.avg(entropy_col).alias("mean_entropy"))
        .withColumn("pct_hallucinated", F.round(F.col("n_hallucinated") / F.col("n_questions") * 100, 1)))


def questions_per_domain(resp: DataFrame, domain_col: str = "domain", key: str = "prompt_id") -> DataFrame:
    """Distinct questions per domain (sort descending when reporting)."""
    return resp.groupBy(domain_col).agg(F.countDistinct(key).alias("n_questions"))


def split_domains(feat: DataFrame, min_questions: int, domain_col: str = "domain") -> DataFrame:
    """Per-domain count and whether it reaches ``min_questions``."""
    return (feat.groupBy(domain_col).agg(F.count(F.lit(1)).alias("n_questions"))
            .withColumn("in_analysis", F.col("n_questions") >= min_questions))


def median_from_counts(counts: DataFrame, keys: list[str], value: str, count_col: str) -> DataFrame:
    """Exact median (mean of the two middle values) from a value-count table."""
    return exact_quantiles(counts, keys, value, count_col, [0.5]).select(
        *keys, F.col("q").alias("median"))


def exact_quantiles(counts: DataFrame, keys: list[str], value: str, count_col: str,
                    probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default).

    ``counts`` holds one row per ``(keys, value)`` with its multiplicity.
    Cumulative counts come from ``prefix_sums`` (no global window); the
    wanted positions per key are attached by an equi-join on the keys and
    matched with an array filter, so there is no range or cross join.
    """
    cum = prefix_sums(counts, keys, [value], {"_cum": F.col(count_col).cast("long")})
    totals = counts.groupBy(*keys).agg(F.sum(count_col).cast("long").alias("_n"))
    pos = totals.select(*keys, "_n", F.array(*[
        F.struct(F.lit(float(p)).alias("p"),
                 F.floor((F.col("_n") - 1) * p).cast("long").alias("lo"),
                 F.ceil((F.col("_n") - 1) * p).cast("long").alias("hi"),
                 ((F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)).alias("frac"))
        for p in probs]).alias("_targets"))
    joined = cum.join(pos, keys, "inner") if keys else cum.crossJoin(F.broadcast(pos))  # one row of positions
    before = F.col("_cum") - F.col(count_col)
    hits = joined.select(*keys, F.col(value).cast("double").alias("_v"), F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.filter("_targets", lambda t: (t["lo"] >= before) & (t["lo"] < F.col("_cum"))).alias("ts")),
        F.struct(F.lit("hi").alias("side"), F.filter("_targets", lambda t: (t["hi"] >= before) & (t["hi"] < F.col("_cum"))).alias("ts")),
    )).alias("h")).select(*keys, "_v", F.col("h.side").alias("side"), F.explode("h.ts").alias("t"))
    piv = hits.groupBy(*keys, F.col("t.p").alias("p"), F.col("t.frac").alias("frac")).agg(
        F.max(F.when(F.col("side") == "lo", F.col("_v"))).alias("vlo"),
        F.max(F.when(F.col("side") == "hi", F.col("_v"))).alias("vhi"))
    return piv.select(*keys, "p", (F.col("vlo") + F.col("frac") * (F.col("vhi") - F.col("vlo"))).alias("q"))


def loading_summary(resp: DataFrame, key: str = "prompt_id", domain_col: str = "domain") -> DataFrame:
    """One-row loading summary."""
    per_q = resp.groupBy(key).agg(F.count(F.lit(1)).alias("spq"))
    dist = per_q.groupBy("spq").agg(F.count(F.lit(1)).alias("_c"))
    med = median_from_counts(dist, [], "spq", "_c")
    head = resp.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_questions"),
                    F.countDistinct(domain_col).alias("n_domains"))
    spread = per_q.agg(F.min("spq").alias("spq_min"), F.max("spq").alias("spq_max"))
    return head.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(med)).withColumnRenamed("median", "spq_median")  # one row each


def label_distribution(resp: DataFrame, correctness: str = "correctness") -> DataFrame:
    """Label counts and percentage of all rows."""
    total = resp.agg(F.count(F.lit(1)).alias("_n"))
    counts = resp.groupBy(correctness).agg(F.count(F.lit(1)).alias("n"))
    return (counts.crossJoin(F.broadcast(total))  # one row
            .select(correctness, "n", F.round(F.col("n") / F.col("_n") * 100, 1).alias("pct")))


def domain_consistency(meta: DataFrame) -> DataFrame:
    """Share of questions with inconsistent domains and the largest count."""
    return meta.agg(F.sum(F.col("domain_inconsistent").cast("int")).alias("n_inconsistent"),
                    F.count(F.lit(1)).alias("n_questions"),
                    F.avg(F.col("domain_inconsistent").cast("double")).alias("inconsistency_rate"),
                    F.max("n_unique_domains").alias("max_unique_domains"))


def filtering_diagnostic(feat: DataFrame, meta: DataFrame, min_questions: int,
                         domain_col: str = "domain") -> DataFrame:
    """Surviving vs raw questions per domain, dropped count, threshold flag."""
    raw = meta.groupBy(F.col("domain_mode").alias(domain_col)).agg(F.count(F.lit(1)).alias("n_raw"))
    surv = feat.groupBy(domain_col).agg(F.count(F.lit(1)).alias("n_surviving"))
    return (raw.join(surv, domain_col, "full_outer")
            .select(domain_col, F.coalesce("n_surviving", F.lit(0)).alias("n_surviving"),
                    F.coalesce("n_raw", F.lit(0)).alias("n_raw"))
            .withColumn("n_dropped", F.col("n_raw") - F.col("n_surviving"))
            .withColumn("below_threshold", F.col("n_surviving") < min_questions))


def crosstab_share(df: DataFrame, row_col: str, col_col: str, columns: list[str]) -> DataFrame:
    """Row-normalised cross-tab over a fixed column list (0 when absent)."""
    wide = df.groupBy(row_col).pivot(col_col, columns).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns), F.lit(0))
    return wide.select(row_col, *[safe_div(F.coalesce(F.col(f"`{c}`"), F.lit(0)), total).alias(c) for c in columns])


def label_fractions_by(feat: DataFrame, by: str) -> DataFrame:
    """Mean label fractions per group."""
    return feat.groupBy(by).agg(F.avg("frac_correct").alias("frac_correct"),
                                F.avg("frac_incorrect").alias("frac_incorrect"),
                                F.avg("frac_refused").alias("frac_refused"))


def non_correct_rate(resp: DataFrame, by: str = "dataset") -> DataFrame:
    """Share of responses not judged correct per dataset."""
    return resp.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                                F.avg((F.lower("correctness") != "correct").cast("double")).alias("non_correct_rate"))


def describe(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """count/mean/std(sample)/min/25%/50%/75%/max per column, exact quartiles.

    Output is long: ``(keys, feature, count, mean, std, min, q25, q50, q75, max)``.
    """
    keys = keys or []
    long = df.select(*keys, *cols).unpivot(keys, cols, "feature", "value")
    long = long.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    k = keys + ["feature"]
    mom = long.groupBy(*k).agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                               F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                               F.max("value").alias("max"))
    counts = long.groupBy(*k, "value").agg(F.count(F.lit(1)).alias("_c"))
    q = exact_quantiles(counts, k, "value", "_c", [0.25, 0.5, 0.75])
    qw = q.groupBy(*k).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                             for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return mom.join(qw, k, "left")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation for every column pair, one aggregate pass."""
    aggs = [correlation(a, b).alias(f"{a}__{b}") for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*aggs)
    pairs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            pairs.append(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"{a}__{b}").alias("r")))
            if a != b:
                pairs.append(F.struct(F.lit(b).alias("f1"), F.lit(a).alias("f2"), F.col(f"{a}__{b}").alias("r")))
    return wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.f1", "p.f2", "p.r")


def correlation_with(df: DataFrame, cols: list[str], target: str, keys: list[str] | None = None) -> DataFrame:
    """Correlation of each feature with the label (sort by |r| to report)."""
    keys = keys or []
    long = df.unpivot(keys + [target], cols, "feature", "value")
    return long.groupBy(*keys, "feature").agg(correlation("value", target).alias("r"))


def group_target(resp: DataFrame, key: str, wrong: str, k: int = 8) -> DataFrame:
    """``n_wrong``, ``n``, ``p_hat`` and ``y = n_wrong >= k`` per group."""
    return (resp.groupBy(key).agg(F.sum(F.col(wrong).cast("int")).alias("n_wrong"), F.count(F.lit(1)).alias("n"))
            .withColumn("p_hat", F.col("n_wrong") / F.col("n"))
            .withColumn("y", (F.col("n_wrong") >= k).cast("int")))


def group_size_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many groups have each size."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))
            .groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups")))


def answers_with_n_questions(df: DataFrame, answer: str, question: str, n: int) -> DataFrame:
    """Answers that have exactly ``n`` distinct questions."""
    return (df.groupBy(answer).agg(F.countDistinct(question).alias("n_questions"))
            .where(F.col("n_questions") == n))


def uniform_group_size(df: DataFrame, key: str) -> DataFrame:
    """Whether all groups have the same size."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.countDistinct("n") == 1).alias("uniform"), F.min("n").alias("min_n"),
                     F.max("n").alias("max_n"))


def pooled_and_by(df: DataFrame, by: str, aggs: list, pooled_label: str = "Pooled") -> DataFrame:
    """``GROUPING SETS ((by), ())`` with the grand total labelled ``pooled_label``."""
    out = df.cube(by).agg(*aggs, F.grouping_id().alias("_gid"))
    return out.withColumn(by, F.when(F.col("_gid") == 1, F.lit(pooled_label)).otherwise(F.col(by))).drop("_gid")


def quota_allocation(counts: DataFrame, group_col: str, count_col: str, target: int) -> DataFrame:
    """base quota ``target // n_groups`` capped by availability, then the
    remainder handed out in descending-count order (ties by name).

    The running sum of spare capacity is cut into slices like any other.
    """
    n_groups = counts.agg(F.count(F.lit(1)).alias("_g"))
    x = (counts.crossJoin(F.broadcast(n_groups))  # one row
         .withColumn("_base", F.least(F.col(count_col), F.floor(F.lit(target) / F.col("_g")).cast("long")))
         .withColumn("_spare", F.col(count_col) - F.col("_base")).withColumn("_neg", -F.col(count_col)).checkpoint())
    left = x.agg((F.lit(target) - F.sum("_base")).alias("_remaining"))
    x = prefix_sums(x, [], ["_neg", group_col], {"_cum": F.col("_spare")}).crossJoin(F.broadcast(left))
    add = F.least(F.col("_spare"), F.greatest(F.lit(0), F.col("_remaining") - (F.col("_cum") - F.col("_spare"))))
    return x.select(group_col, count_col, (F.col("_base") + add).cast("long").alias("quota"))


def ordered_feature_union(df: DataFrame, features: list[str], label: str, ks: DataFrame, top: int) -> DataFrame:
    """The ``top`` features by falling absolute correlation, then the KS-significant ones in feature order, each once."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    cor = correlation_with(df, features, label).select("feature", F.coalesce(F.abs("r"), F.lit(0.0)).alias("size"), place.alias("at"))
    # one row a feature
    best = cor.orderBy(F.col("size").desc(), "at").limit(top).agg(F.array_sort(F.collect_list(F.struct(-F.col("size"), "at", "feature"))).alias("b"))
    sig = ks.where("significant").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "feature"))).alias("a"))
    both = F.concat(F.transform("b", lambda s: s["feature"]), F.transform("a", lambda s: s["feature"]))
    return best.crossJoin(F.broadcast(sig)).select(F.array_join(F.array_distinct(both), ",").alias("features"))


def sample_per_class(df: DataFrame, label: str, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows of each class in the order of md5 draws."""
    w = Window.partitionBy(label).orderBy(md5_int(F.lit(seed), F.col(id_col)), F.col(id_col))
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= size).drop("_rk")


def results_summary(resp: DataFrame, feat: DataFrame, tests: DataFrame, labels: list[str], min_questions: int,
                    by: str = "dataset", key: str = "prompt_id") -> DataFrame:
    """Per dataset, questions read, analysed and skipped, domains with enough of them, response labels, question labels and the test."""
    share = [F.round(F.avg((F.lower("correctness") == c).cast("double")) * 100, 1).alias(f"pct_{c}") for c in labels]
    raw = resp.groupBy(by).agg(F.countDistinct(key).alias("n_questions"), F.count(F.lit(1)).alias("n_responses"),
                               *[F.sum((F.lower("correctness") == c).cast("int")).alias(f"n_{c}") for c in labels], *share)
    done = feat.groupBy(by).agg(F.count(F.lit(1)).alias("n_analysed"), F.sum((F.col("label") == 0).cast("int")).alias("n_label_correct"),
                                F.sum((F.col("label") == 1).cast("int")).alias("n_label_hallucinated"),
                                F.round(F.avg("label") * 100, 1).alias("pct_hallucinated"))
    domains = (feat.groupBy(by, "domain").agg(F.count(F.lit(1)).alias("n"))
               .groupBy(by).agg(F.sum((F.col("n") >= min_questions).cast("int")).alias("n_domains_analysed"),
                                F.sum((F.col("n") < min_questions).cast("int")).alias("n_domains_excluded")))
    return (raw.join(done, by, "left").join(domains, by, "left").join(tests.select(by, "delta", "p_value"), by, "left")
            .withColumn("n_skipped", F.col("n_questions") - F.coalesce("n_analysed", F.lit(0))))
