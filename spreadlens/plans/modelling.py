"""The reference's model comparisons as one grid of models over the question table.

All selections, ablations, per-domain and leave-one-out tests fit the same five classifiers on feature sets and row splits of one
table.  ``grid_scores`` fits every one of them in the shared passes of ``batch_linear`` and ``batch_trees`` and returns their scores; the
queries are groupings of it.  The scores are written to the checkpoint folder once for a Spark application and input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import md5_int
from ..operators import batch_linear as BL
from ..operators import batch_trees as BT
from ..operators import hypothesis as H
from ..operators import metrics as M
from ..operators import rollup as R
from ..operators.models import impute_median, stratified_folds, stratified_split
from ..operators.partials import EVERY, Split, matrix
from ..sources import fixtures as FX
from .features import question_features

# Feature names, feature sets and classifiers of the comparisons.
BASE = ["H_sem", "D_cos", "D_cos_var", "D_pair", "K", "sig2_S"]
SPECTRAL = ["lam2", "lam3", "SGR", "spectral_entropy", "ipr_fiedler", "HFER"]
CLUSTER = ["largest_cluster_frac", "second_largest_cluster_frac", "singleton_cluster_frac"]
FEATURES = BASE + SPECTRAL + CLUSTER
BASE_SETS = {"Entropy only (H_sem)": ["H_sem"], "Geometry only (D_cos, D_cos_var, D_pair)": ["D_cos", "D_cos_var", "D_pair"],
             "Entropy + Geometry": ["H_sem", "D_cos", "D_cos_var", "D_pair"], "All 6 geometric": BASE}
SPECTRAL_SETS = {"Spectral only": SPECTRAL, "All 9 new": SPECTRAL + CLUSTER, "Full 15": FEATURES}
SELECTED = "Most significant"
CLASSIFIERS = ["logistic", "elastic_net", "random_forest", "gradient_boosting", "boosted_trees"]
FOLDS = 5
COLUMNS = ["fold", "dataset", "group_fold", "part", "cell"]
NAMES = ["task", "variant", "classifier", "held"]

_done: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """``make()``'s table, checkpointed the first time an application asks for it over an input."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _done:
        _done[key] = make().checkpoint()
    return _done[key]


def question_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled questions with all fifteen features; a feature a small question lacks is the median."""
    def make():
        q = question_features(FX.responses(spark, sf), FX.text_cloud(spark, sf)).withColumn("K", F.col("K").cast("double"))
        # rounded, so that values that are equal but for the order of summation are equal
        q = impute_median(q.withColumns({f: F.round(f, 9) for f in FEATURES}).checkpoint(), FEATURES)
        q = stratified_folds(q.withColumn("row_id", F.col("prompt_id")), "row_id", "label", FOLDS)
        q = stratified_split(q, "row_id", "label", 0.2)
        q = stratified_folds(q.withColumnRenamed("fold", "_fold"), "row_id", "label", FOLDS, 43, ["domain"]).withColumnRenamed("fold", "_within").withColumnRenamed("_fold", "fold")
        sizes = q.groupBy("domain").agg(F.least(F.sum("label"), F.sum(1 - F.col("label")), F.lit(FOLDS)).cast("int").alias("_k"))
        q = q.join(sizes, "domain", "left")
        return q.withColumns({
            "part": F.when(F.col("is_test"), "test").otherwise("train"),
            "cell": F.when(F.col("is_test"), "test").otherwise((md5_int(F.lit("cell"), F.col("row_id")) % 3).cast("string")),
            "domain_folds": F.col("_k"),
            "group_fold": F.when(F.col("_k") >= 2, F.concat_ws("|", "domain", (F.col("_within") % F.col("_k")).cast("string")))}).drop("_k", "_within")
    return once(spark, sf, "question_rows", make)


def selected_features(rows: DataFrame) -> list[str]:
    """The four base features most correlated with the label, then the KS-significant new ones."""
    ks = H.ks_tests(FX.feature_long(rows, SPECTRAL + CLUSTER, ["label"]), ["feature"], n_tests=len(SPECTRAL + CLUSTER))
    got = R.ordered_feature_union(rows, BASE, "label", ks, 4).first()["features"]
    return got.split(",") if got else BASE[:4]


def model(names: tuple[str, ...], features: list[str], split: Split):
    """One model of a classifier's name (the third of ``names``)."""
    at, kind = tuple(FEATURES.index(f) for f in features), names[2]
    if kind in ("logistic", "logistic_balanced"):
        return BL.Linear(names, at, split, balanced=kind != "logistic")
    if kind in ("elastic_net", "elastic_net_25"):
        return BL.Linear(names, at, split, l1_ratio=0.25 if kind.endswith("25") else 0.5)
    return BT.settings(names, at, split, kind)


def grid(rows: DataFrame) -> list:
    """All models of the comparisons."""
    sets = BASE_SETS | SPECTRAL_SETS | {SELECTED: selected_features(rows)}
    # a question without a dataset trains all of these models and is held out by none
    datasets = [r[0] for r in rows.where("dataset is not null").select("dataset").distinct().orderBy("dataset").limit(1000).collect()]
    domains = [(r[0], r[1]) for r in rows.where("domain_folds >= 2").select("domain", "domain_folds").distinct().orderBy("domain").limit(1000).collect()]
    out = [model(("cv", v, c, str(f)), fs, Split("fold", str(f))) for v, fs in sets.items() for c in CLASSIFIERS for f in range(FOLDS)]
    out += [model(("lobo", v, c, d), fs, Split("dataset", d)) for v, fs in BASE_SETS.items() for c in CLASSIFIERS for d in datasets]
    out += [model(("domain", d, c, str(f)), BASE, Split("group_fold", tuple(f"{d}|{g}" for g in range(k) if g != f), True, ("_domain", d)))
            for d, k in domains for c in CLASSIFIERS for f in range(k)]
    out += [model(("transfer", "All 6 geometric", "logistic", d), BASE, Split("dataset", d, True)) for d in datasets]
    extra = ["logistic_balanced", "elastic_net_25", "random_forest_leaf", "adaboost"]
    out += [model(("holdout", "All 6 geometric", c, "test"), BASE, Split("part", "test")) for c in CLASSIFIERS + extra]
    return out


def grid_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(task, variant, classifier, held, id, y, p, trained) of all models: held-out rows, and for ``lobo`` and ``transfer`` all rows."""
    def make():
        q = question_rows(spark, sf).withColumn("_domain", F.col("domain"))
        columns = [*COLUMNS, "_domain"]
        rows = matrix(q, "row_id", "label", FEATURES, columns)
        models = grid(q)
        linear, trees = ([m for m in models if isinstance(m, kind)] for kind in (BL.Linear, BT.Ensemble))
        a = BL.fit(rows, linear, len(FEATURES), columns).scores(rows, NAMES, held_out=False)
        b = BT.fit(rows, trees, len(FEATURES), columns).scores(NAMES, held_out=False)
        return a.unionByName(b).where(~F.col("trained") | F.col("task").isin("lobo", "transfer"))
    return once(spark, sf, "grid_scores", make)


def selection(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation over folds of AUC and average precision, by ``keys``."""
    per = M.ranked_counts(scores, [*keys, "held"], "p", "y").groupBy(*keys, "held").agg(M._auc().alias("auc"), M._ap().alias("ap"))
    return per.groupBy(*keys).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.avg("ap").alias("ap_mean"),
                                  F.stddev_pop("ap").alias("ap_std"), F.count("auc").cast("int").alias("folds"))


def bundle(pred: DataFrame, coefficients: DataFrame | None = None) -> DataFrame:
    """Metrics, threshold rows, curve points, predictions and coefficients as rows (part, place, name, value)."""
    def long(df, part, place):
        values = [c for c in df.columns if c != place]
        x = df.select(F.col(place).cast("string").alias("place"), *[F.col(c).cast("double").alias(c) for c in values])
        return x.unpivot(["place"], values, "name", "value").select(F.lit(part).alias("part"), "place", "name", "value")

    metrics = M.classification_metrics(pred, [], "p", "y").withColumn("of", F.lit("all"))
    parts = [long(metrics, "metrics", "of"), long(M.threshold_table(pred, [], "p", "y"), "thresholds", "threshold"),
             long(M.curve_points(pred, [], "p", "y"), "curve", "threshold"),
             long(pred.select("id", "y", "p", (F.col("p") >= 0.5).cast("int").alias("predicted")), "predictions", "id")]
    if coefficients is not None:
        parts.append(long(coefficients.select("feature", "coefficient", F.abs("coefficient").alias("size")), "coefficients", "feature"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holdout_coefficients(spark: SparkSession, sf: str, kind: str = "logistic") -> DataFrame:
    rows = matrix(question_rows(spark, sf), "row_id", "label", FEATURES, COLUMNS)
    fitted = BL.fit(rows, [model(("holdout", "", kind, ""), BASE, Split("part", "test"))], len(FEATURES), COLUMNS)
    return fitted.coefficients(rows, NAMES, FEATURES)


# ------------------------------------------------------------------ eigen vectors: bake-off and grid

EIGEN_WIDTH = 64
#: The reference's numbers of components for 6,720 columns, as shares of the vectors' length.
SHARES = {"256": 256 / 768, "384": 384 / 768, "512": 512 / 768, "768": 1.0}


def eigen_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row a sample: eigen features e0 ..., class, and the hold-out split, its three calibration cells and two folds."""
    def make():
        from ..operators import attention as A
        eig = FX.eigen_long(spark, sf)
        v = A.whole_vectors(A.eigen_vectors(eig, 4, 4, 4), EIGEN_WIDTH).join(eig.select("id", "label").distinct(), "id")
        v = v.select("id", "label", *[F.get("features", F.lit(i)).cast("double").alias(f"e{i}") for i in range(EIGEN_WIDTH)]).checkpoint()
        v = impute_median(v, [f"e{i}" for i in range(EIGEN_WIDTH)])
        v = stratified_split(stratified_folds(v, "id", "label", 2), "id", "label", 0.2)
        return v.withColumn("cell", F.when(F.col("is_test"), "test").otherwise((md5_int(F.lit("cell"), F.col("id")) % 3).cast("string"))).withColumn(
            "part", F.when(F.col("is_test"), "test").otherwise("train"))
    return once(spark, sf, "eigen_rows", make)


EIGEN_COLUMNS = ["fold", "part", "cell"]


def eigen_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(eigen_rows(spark, sf), "id", "label", [f"e{i}" for i in range(EIGEN_WIDTH)], EIGEN_COLUMNS)


def scaled(k: str) -> int:
    return max(1, round(SHARES[k] * EIGEN_WIDTH))


def bakeoff_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(classifier, id, y, p) of the hold-out rows for the five pipelines on principal components."""
    rows = eigen_matrix(spark, sf)
    split, every = Split("part", "test"), tuple(range(EIGEN_WIDTH))
    n = rows.where(F.get("splits", F.lit(1)) == "train").count()
    linear = [BL.Linear(("logistic_pca",), every, split, balanced=True, components=scaled("384")),
              # a penalty of 0.001 on the mean loss
              BL.Linear(("sgd_elastic_net_pca",), every, split, 1 / (0.001 * max(n, 1)), 0.25, components=scaled("256"))]
    out = BL.fit(rows, linear, EIGEN_WIDTH, EIGEN_COLUMNS).scores(rows, ["classifier"]).select("classifier", "id", "y", "p")
    out = out.unionByName(BL.calibrated_margins(rows, ("svm_calibrated_pca",), ["classifier"], every, EIGEN_WIDTH, "cell", "test", ["0", "1", "2"], EIGEN_COLUMNS,
                                                components=scaled("768")))
    for kind, k, scale in (("random_forest_leaf", "384", True), ("adaboost", "512", False)):
        turned = BL.components(rows, split, scaled(k), EIGEN_WIDTH, EIGEN_COLUMNS, scale)
        fitted = BT.fit(turned, [BT.settings((kind + "_pca",), tuple(range(scaled(k))), split, kind)], scaled(k), EIGEN_COLUMNS)
        out = out.unionByName(fitted.scores(["classifier"]).select("classifier", "id", "y", "p"))
    return out


def search_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out scores of the whole grid: components x whitening x penalty x C x l1 ratio x class weight, in two folds."""
    rows = eigen_matrix(spark, sf)
    every = tuple(range(EIGEN_WIDTH))
    models = [BL.Linear((k, str(w).lower(), "l2" if not l1 else "elasticnet", str(c), str(l1), str(b).lower(), str(f)), every, Split("fold", str(f)), c, l1, b, scaled(k), w)
              for k in ("256", "384", "512") for w in (False, True) for c in (0.01, 0.03, 0.1) for l1 in (0.0, 0.1, 0.3, 0.5) for b in (False, True) for f in range(2)]
    names = ["components", "whiten", "penalty", "c", "l1_ratio", "balanced", "held"]
    return BL.fit(rows, models, EIGEN_WIDTH, EIGEN_COLUMNS).scores(rows, names)
