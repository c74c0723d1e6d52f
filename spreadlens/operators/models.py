"""Feature preparation, classifiers and evaluation loops.

Estimators are Spark ML (distributed fitting); scores are evaluated with
the exact rank-based metrics of ``metrics`` on prediction tables, never by
collecting predictions.  Splits and folds are md5-seeded per class, so
they are reproducible and checkable in SQL.  Loops exist only over a small
number of *models* (folds × classifiers × subsets) — each iteration is a
distributed fit — never over rows or groups of rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, LogisticRegressionModel, RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import md5_int
from . import batch_trees, wide_pca
from . import metrics as M
from .attention import whole_vectors
from .dealt import Scorer, dealt_auc
from .partials import matrix
from .ranking import row_numbers
from .rollup import exact_quantiles, median_from_counts
from .tiled_graph import written

#: Bits of a draw (28 in all) below its bucket's.
BUCKET_BITS = 16


# ------------------------------------------------------------------ M1 / M3 / M4

def standardize(df: DataFrame, cols: list[str], keys: list[str] | None = None, suffix: str = "_z") -> DataFrame:
    """M1: z-score with the population SD (constant columns → 0), fitted per ``keys``."""
    keys = keys or []
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                  *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    x = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # one row of statistics
    for c in cols:
        s = F.col(f"_s_{c}")
        x = x.withColumn(c + suffix, F.when((s == 0) | s.isNull(), F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / s))
    return x.drop(*[f"_{p}_{c}" for c in cols for p in ("m", "s")])


def _class_order(df: DataFrame, id_col: str, label: str, seed: int, keys: list[str]) -> DataFrame:
    x = df.withColumn("_u", md5_int(F.lit(seed), F.col(id_col)))
    return row_numbers(x, keys + [label], ["_u", id_col], "_rn")


def stratified_split(df: DataFrame, id_col: str, label: str, test_frac: float = 0.2, seed: int = 42,
                     keys: list[str] | None = None) -> DataFrame:
    """M3: per class, the first ``round(n_c · test_frac)`` rows in md5 order are test.

    Only the last test row of each class is looked for: counts by the draws' leading bits name the few rows around it,
    and only those are put in order.  Rows without a label or key are left out.
    """
    by = [*(keys or []), label]
    x = df.where(reduce(and_, [F.col(c).isNotNull() for c in by])).withColumns(
        {"_u": md5_int(F.lit(seed), F.col(id_col)).cast("int"), "_at": F.monotonically_increasing_id()})
    x = written(x)
    bucket = F.shiftright("_u", BUCKET_BITS).alias("_bucket")
    counts = x.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    ranked = counts.withColumns({"_cum": F.sum("_c").over(running), "_need": F.round(F.sum("_c").over(whole) * test_frac)})
    # one bucket a class
    edge = ranked.where("_cum >= _need and _cum - _c < _need").select(*by, "_bucket", (F.col("_need") - F.col("_cum") + F.col("_c")).alias("_left"))
    edge = edge.checkpoint()
    around = x.select(*by, "_u", F.col(id_col).alias("_id"), "_at", bucket).join(edge if keys else F.broadcast(edge), [*by, "_bucket"])
    last = row_numbers(around, by, ["_u", "_id", "_at"], "_rn").where("_rn = _left").select(*by, F.struct("_u", "_id", "_at").alias("_last")).checkpoint()
    x = x.join(last if keys else F.broadcast(last), by, "left")  # without keys, a row a class
    own = F.struct(F.col("_u"), F.col(id_col).alias("_id"), F.col("_at"))
    return x.select(*by, *[c for c in df.columns if c not in by], (F.col("_last").isNotNull() & F.coalesce(own <= F.col("_last"), F.lit(False))).alias("is_test"))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                     keys: list[str] | None = None) -> DataFrame:
    """M4: fold = (rank in class, md5 order) mod k."""
    keys = keys or []
    x = _class_order(df, id_col, label, seed, keys)
    return x.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_u", "_rn")


# ------------------------------------------------------------------ estimators

def balanced_weights(df: DataFrame, label: str, out: str = "w") -> DataFrame:
    """Class weight ``n / (2 · n_c)`` (the 'balanced' rule)."""
    y = F.col(label).cast("int")
    n = df.agg(F.sum(y).alias("_n1"), F.sum(1 - y).alias("_n0"))
    x = df.crossJoin(F.broadcast(n))  # one row of counts
    own = F.when(y == 1, F.col("_n1")).otherwise(F.col("_n0"))
    return x.withColumn(out, (F.col("_n1") + F.col("_n0")) / (2.0 * own)).drop("_n1", "_n0")


def groups_of(df: DataFrame, group_col: str, limit: int = 1000) -> list:
    """The distinct values of a grouping column, from the data; models are fitted one by one, so their number is bounded."""
    found = [r[0] for r in df.select(group_col).where(F.col(group_col).isNotNull()).distinct().orderBy(group_col).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{group_col} has more than {limit} values")
    return found


def classifier(name: str, n_train: int | None = None, seed: int = 42, weight_col: str | None = None,
               c: float = 1.0):
    """The reference's classifier zoo on Spark ML.

    Logistic models use ``regParam = 1/(C·n)`` (the usual C ↔ λ mapping)
    and ``standardization=False`` because inputs are standardised first.
    """
    reg = 1.0 / (c * max(n_train or 1, 1))
    common = {"featuresCol": "features", "labelCol": "label"}
    if weight_col and name in ("logistic", "elastic_net", "elastic_net_25", "random_forest", "random_forest_leaf", "gradient_boosting", "boosted_trees"):
        common["weightCol"] = weight_col
    if name == "logistic":
        return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=100, **common)
    if name == "elastic_net":
        return LogisticRegression(regParam=reg, elasticNetParam=0.5, standardization=False, maxIter=100, **common)
    if name == "elastic_net_25":
        return LogisticRegression(regParam=reg, elasticNetParam=0.25, standardization=False, maxIter=100, **common)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=200, maxDepth=6, seed=seed, **common)
    if name == "random_forest_leaf":
        return RandomForestClassifier(numTrees=200, maxDepth=6, minInstancesPerNode=5, seed=seed, **common)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **common)
    if name == "boosted_trees":
        return GBTClassifier(maxIter=200, maxDepth=4, stepSize=0.1, seed=seed, **common)
    raise ValueError(name)


def prepare(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Assemble feature columns into a vector and name the label ``label``."""
    x = df.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(x)


def positive_prob(pred: DataFrame, out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def fit_score(train: DataFrame, test: DataFrame, features: list[str], label: str, model: str,
              seed: int = 42, balanced: bool = False) -> DataFrame:
    """Standardise on train, fit, score test; returns test rows with ``p``."""
    return fit_model(train, features, label, model, seed, balanced)[1](test)


def fit_model(train: DataFrame, features: list[str], label: str, model: str, seed: int = 42, balanced: bool = False):
    """The fitted Spark ML model, and a function that scores rows with it (standardised as the training rows)."""
    z = [f + "_z" for f in features]
    stats = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])

    def apply(d):
        x = d.crossJoin(F.broadcast(stats))  # one row of statistics
        for f in features:
            s = F.col(f"s_{f}")
            x = x.withColumn(f + "_z", F.when((s == 0) | s.isNull(), 0.0).otherwise((F.col(f) - F.col(f"m_{f}")) / s))
        return prepare(x, z, label)

    stats = stats.checkpoint()
    tr = apply(train)
    wcol = None
    if balanced:
        tr = balanced_weights(tr, "label")
        wcol = "w"
    est = classifier(model, n_train=None, seed=seed, weight_col=wcol)
    if isinstance(est, LogisticRegression):
        n = tr.count()
        est = est.setRegParam(1.0 / max(n, 1))
    fitted = est.fit(tr)

    def score(test):
        return positive_prob(fitted.transform(apply(test)))

    score.stats = stats
    return fitted, score


# ------------------------------------------------------------------ M8 / M9

def svm_platt(train: DataFrame, test: DataFrame, features: list[str], label: str, folds: int = 3,
              id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """M8: linear SVM margins calibrated by a one-feature logistic fit (Platt),
    the calibrator trained on out-of-fold margins."""
    tr = stratified_folds(train, id_col, label, folds, seed).checkpoint()
    oof = None
    for k in range(folds):
        fit = LinearSVC(maxIter=100, regParam=0.01).fit(prepare(tr.where(F.col("fold") != k), features, label))
        m = fit.transform(prepare(tr.where(F.col("fold") == k), features, label)) \
            .select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        oof = m if oof is None else oof.unionByName(m)
    platt = LogisticRegression(featuresCol="mf", labelCol="label").fit(
        VectorAssembler(inputCols=["margin"], outputCol="mf").transform(oof))
    svm = LinearSVC(maxIter=100, regParam=0.01).fit(prepare(train, features, label))
    te = svm.transform(prepare(test, features, label)).withColumn("margin", vector_to_array("rawPrediction")[1])
    te = VectorAssembler(inputCols=["margin"], outputCol="mf").transform(te.drop("probability", "prediction"))
    return positive_prob(platt.transform(te.drop("rawPrediction")))


def adaboost(train: DataFrame, test: DataFrame, features: list[str], label: str, rounds: int = 300,
             learning_rate: float = 0.05, checkpoint_every: int = 3) -> DataFrame:
    """M9: discrete AdaBoost (SAMME) of depth-1 trees; weights updated as a
    DataFrame expression each round, lineage cut with ``checkpoint()``."""
    tr = prepare(train, features, label).withColumn("w", F.lit(1.0)).checkpoint()
    te = prepare(test, features, label).withColumn("_score", F.lit(0.0)).checkpoint()
    for r in range(rounds):
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="w", labelCol="label", featuresCol="features").fit(tr)
        pr = stump.transform(tr).withColumn("_miss", (F.col("prediction") != F.col("label")).cast("double"))
        err = pr.agg((F.sum(F.col("w") * F.col("_miss")) / F.sum("w")).alias("e")).first()["e"]
        err = min(max(err, 1e-10), 1 - 1e-10)
        alpha = learning_rate * float(__import__("math").log((1 - err) / err))
        tr = pr.withColumn("w", F.col("w") * F.exp(F.lit(alpha) * F.col("_miss"))).drop(
            "_miss", "prediction", "rawPrediction", "probability")
        te = stump.transform(te).withColumn(
            "_score", F.col("_score") + F.lit(alpha) * (2 * F.col("prediction") - 1)).drop(
            "prediction", "rawPrediction", "probability")
        if (r + 1) % checkpoint_every == 0:
            tr = tr.checkpoint()
            te = te.checkpoint()
    return te.withColumn("p", 1.0 / (1.0 + F.exp(-2.0 * F.col("_score"))))


# ------------------------------------------------------------------ M10–M16 evaluation loops

ZOO = ["logistic", "elastic_net", "random_forest", "gradient_boosting", "boosted_trees"]


def oof_predictions(df: DataFrame, features: list[str], label: str, models: list[str] = ZOO, k: int = 5,
                    id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """Out-of-fold scores ``(model, fold, id, y, p)`` for each model."""
    folded = stratified_folds(df, id_col, label, k, seed).checkpoint()
    out = None
    for m in models:
        for f in range(k):
            s = fit_score(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), features, label, m,
                          seed).select(F.lit(m).alias("model"), F.lit(f).alias("fold"), id_col,
                                       F.col(label).cast("int").alias("y"), "p")
            out = s if out is None else out.unionByName(s)
    return out


def cv_selection(oof: DataFrame) -> DataFrame:
    """AUC and AP mean/std (population) over folds per model, ``rank`` 1 for the best mean AUC."""
    ranked = M.ranked_counts(oof, ["model", "fold"], "p", "y")
    per = ranked.groupBy("model", "fold").agg(M._auc().alias("auc"), M._ap().alias("average_precision"))
    means = per.groupBy("model").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
                                     F.avg("average_precision").alias("ap_mean"),
                                     F.stddev_pop("average_precision").alias("ap_std"))
    # one row a model
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.col("auc_mean").desc(), "model")))


def holdout_eval(df: DataFrame, features: list[str], label: str, models: str | list[str], id_col: str = "row_id",
                 seed: int = 42) -> DataFrame:
    """Fit each model on the same stratified 80 %, evaluate on the other 20 % (AUC, AP, Brier, @0.5)."""
    sp = stratified_split(df, id_col, label, 0.2, seed).checkpoint()
    out = None
    for m in [models] if isinstance(models, str) else models:
        pred = fit_score(sp.where(~F.col("is_test")), sp.where(F.col("is_test")), features, label, m, seed)
        r = M.classification_metrics(pred.withColumn("y", F.col(label).cast("int")), [], "p", "y").withColumn("model", F.lit(m))
        out = r if out is None else out.unionByName(r)
    return out


def final_evaluation(df: DataFrame, features: list[str], label: str, model: str, id_col: str = "row_id",
                     seed: int = 42) -> dict[str, DataFrame]:
    """The whole bundle of one model on the hold-out split.

    ``metrics``, ``thresholds``, ``curve`` (ROC and PR points), ``predictions``,
    and for the linear models ``coefficients`` by falling size.
    """
    sp = stratified_split(df, id_col, label, 0.2, seed).checkpoint()
    fitted, score = fit_model(sp.where(~F.col("is_test")), features, label, model, seed)
    pred = score(sp.where(F.col("is_test"))).select(id_col, F.col(label).cast("int").alias("y_true"), F.col("p").alias("y_prob"),
                                                    (F.col("p") >= 0.5).cast("int").alias("y_pred")).checkpoint()
    out = {"metrics": M.classification_metrics(pred, [], "y_prob", "y_true"), "thresholds": M.threshold_table(pred, [], "y_prob", "y_true"),
           "curve": M.curve_points(pred, [], "y_prob", "y_true"), "predictions": pred}
    if hasattr(fitted, "coefficients"):
        rows = sorted(((f, float(c), abs(float(c))) for f, c in zip(features, fitted.coefficients.toArray(), strict=True)), key=lambda r: -r[2])
        out["coefficients"] = df.sparkSession.createDataFrame(rows, "feature string, coefficient double, abs_coef double")
    return out


def per_group_cv(df: DataFrame, group_col: str, features: list[str], label: str, models: list[str] = ZOO, id_col: str = "row_id",
                 seed: int = 42, folds: int = 5) -> DataFrame:
    """One model a group: cross-validated AUC of each model, fitted and tested inside each group alone.

    Groups with one class, or with fewer than two rows of a class, are skipped;
    the number of folds is ``min(folds, smallest class)``.
    """
    sizes = df.groupBy(group_col).agg(F.sum(F.col(label).cast("int")).alias("n1"), F.sum(1 - F.col(label).cast("int")).alias("n0")).checkpoint()
    out = None
    for g in groups_of(df, group_col):
        n1, n0 = sizes.where(F.col(group_col) == g).select("n1", "n0").first()
        k = min(folds, n1, n0)
        if k < 2:
            continue
        own = cv_selection(oof_predictions(df.where(F.col(group_col) == g), features, label, models, k, id_col, seed)).select(
            F.lit(g).alias(group_col), "model", "auc_mean", "auc_std", F.lit(n1 + n0).alias("n_rows"), F.lit(k).alias("folds"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return df.sparkSession.createDataFrame([], f"{group_col} string, model string, auc_mean double, auc_std double, n_rows bigint, folds int")
    return out


def _auc_by(pred: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    return M.auc(pred.withColumn("y", F.col(label).cast("int")), keys or [], "p", "y")


def leave_one_out(df: DataFrame, group_col: str, features: list[str], label: str, model: str) -> DataFrame:
    """Train on all other groups, AUC on them and on the held-out one; the groups come from the data."""
    out = None
    for g in groups_of(df, group_col):
        rest = df.where(F.col(group_col) != g)
        score = fit_model(rest, features, label, model)[1]
        test = _auc_by(score(df.where(F.col(group_col) == g)), label)
        r = test.crossJoin(F.broadcast(_auc_by(score(rest), label).select(F.col("auc").alias("train_auc")))).withColumn("held_out", F.lit(g))
        out = r if out is None else out.unionByName(r)
    return out


def transfer_matrix(df: DataFrame, group_col: str, features: list[str], label: str, model: str) -> DataFrame:
    """Train on one group, score every group; the diagonal is in-sample; the groups come from the data."""
    out = None
    for g in groups_of(df, group_col):
        pred = fit_score(df.where(F.col(group_col) == g), df, features, label, model)
        r = (_auc_by(pred, label, [group_col]).withColumnRenamed(group_col, "test").withColumn("train", F.lit(g))
             .withColumn("in_sample", F.col("test") == F.col("train")))
        out = r if out is None else out.unionByName(r)
    return out


def sampling_transfer(a: DataFrame, b: DataFrame, features: list[str], label: str, model: str, id_col: str, names: tuple[str, str],
                      seed: int = 0) -> DataFrame:
    """Two feature sets of the same questions: each tested on its own hold-out split, and trained on one and tested on the other.

    Each row has the 5-fold CV AUC and AP on its training rows and the test AUC and AP.
    """
    def one(train, test, setting):
        k = cv_selection(oof_predictions(train, features, label, [model], 5, id_col, seed)).drop("model", "rank")
        pred = fit_score(train, test, features, label, model, seed).withColumn("y", F.col(label).cast("int"))
        t = M.ranked_counts(pred, [], "p", "y").groupBy().agg(M._auc().alias("test_auc"), M._ap().alias("test_ap"))
        return k.crossJoin(F.broadcast(t)).select(F.lit(setting).alias("setting"), *[F.col(c).alias(f"cv_{c}") for c in
                                                  ("auc_mean", "auc_std", "ap_mean", "ap_std")], "test_auc", "test_ap")

    out = None
    for x, n in ((a, names[0]), (b, names[1])):
        sp = stratified_split(x, id_col, label, 0.2, seed).checkpoint()
        r = one(sp.where(~F.col("is_test")).drop("is_test"), sp.where(F.col("is_test")).drop("is_test"), f"{n} -> {n}")
        out = r if out is None else out.unionByName(r)
    return out.unionByName(one(a, b, f"{names[0]} -> {names[1]}")).unionByName(one(b, a, f"{names[1]} -> {names[0]}"))


# ------------------------------------------------------------------ M2 / M24 probe

def probe_pipeline(k: int, features_col: str = "features", balanced: bool = True, whiten: bool = False, reg: float = 0.01) -> Pipeline:
    """Standardise → PCA(k), whitened if asked for → (balanced) logistic regression, on imputed vectors."""
    return Pipeline(stages=[
        StandardScaler(inputCol=features_col, outputCol="_std", withMean=True, withStd=True),
        PCA(k=k, inputCol="_std", outputCol="_turned"),
        StandardScaler(inputCol="_turned", outputCol="_pca", withMean=False, withStd=whiten),
        LogisticRegression(featuresCol="_pca", labelCol="label", maxIter=200, regParam=reg,
                           **({"weightCol": "w"} if balanced else {})),
    ])


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null and NaN entries become the column's exact median (of all columns from one table of value counts).

    A column without any value stays null.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value").where("value is not null and not isnan(value)")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_c"))
    medians = median_from_counts(counts, ["feature"], "value", "_c").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("_m"))
    x = df.crossJoin(F.broadcast(medians))  # one row, one entry a column
    return x.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.col("_m")[c]).otherwise(F.col(c)) for c in cols}).drop("_m")


def impute_vectors(train: DataFrame, test: DataFrame, vec_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """M24's first step on array columns: non-finite entries become the training rows' median of that place."""
    place = train.select(F.posexplode(vec_col).alias("pos", "v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    medians = place.groupBy("pos").agg(F.percentile_approx("v", 0.5, 10000).alias("m"))
    fill = medians.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("pos", "m"))).alias("_m"))  # at most ``size`` entries

    def done(df):
        x = df.crossJoin(F.broadcast(fill))
        ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        return x.withColumn(vec_col, F.transform(vec_col, lambda v, i: F.when(ok(v), v).otherwise(F.coalesce(F.col("_m")[i], F.lit(0.0))))).drop("_m")

    return done(train), done(test)


def pca_variance(df: DataFrame, vec_col: str, k: int) -> DataFrame:
    """M2: explained and cumulative variance ratio of the first k components of standardised inputs, for vectors of any length."""
    model = wide_pca.fit(df, vec_col, k, scaled=True)
    return model.table(df.sparkSession) if model else df.sparkSession.createDataFrame([], "component int, explained double, cumulative double")


def probe_split(labels: DataFrame, seed: int = 42) -> DataFrame:
    """(id, label, is_test): the split that all probes of a comparison share."""
    return stratified_split(labels.select("id", "label"), "id", "label", 0.2, seed)


def probe_eval(eig_vec: DataFrame, labels: DataFrame, k: int, size: int, split: DataFrame | None = None, seed: int = 42,
               **options) -> DataFrame:
    """Impute, fit the probe on the training split, AUC on the test split.

    ``size`` is the vectors' length; k is at most that and the number of
    training rows.  A vector of another length is an error.
    """
    sp = whole_vectors(eig_vec, size).join(probe_split(labels, seed) if split is None else split, "id")
    sp = sp.withColumn("label", F.col("label").cast("double")).checkpoint()
    train, test = impute_vectors(sp.where(~F.col("is_test")), sp.where(F.col("is_test")), "features", size)
    k = max(1, min(k, size, sp.where(~F.col("is_test")).count()))
    model = probe_pipeline(k, "vec", **options).fit(balanced_weights(train.withColumn("vec", array_to_vector("features")), "label"))
    pred = positive_prob(model.transform(test.withColumn("vec", array_to_vector("features"))))
    return M.auc(pred.withColumn("y", F.col("label").cast("int")), [], "p", "y")


def permutation_importance(df: DataFrame, features: list[str], label: str, id_col: str, model: str = "logistic", repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    """Mean fall of the hold-out AUC when one feature's values are dealt anew among the test rows.

    A row takes the value of the row that follows it in the order of md5 draws.
    """
    rows = df.select(id_col, label, *features, F.monotonically_increasing_id().alias("_row"))
    sp = stratified_split(rows, id_col, label, 0.2, seed)
    fitted, score = fit_model(sp.where(~F.col("is_test")), features, label, model, seed)
    test = sp.where(F.col("is_test")).select(id_col, label, *features, "_row")
    found = None
    if isinstance(fitted, LogisticRegressionModel) and fitted.numClasses == 2:
        stats = score.stats.first()
        scorer = Scorer([stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] for f in features], fitted.coefficients.toArray(), fitted.intercept)
        found = dealt_auc(test, id_col, "_row", label, features, scorer, repeats, seed)
    per, base = found or _dealt_scores(test.drop("_row"), features, label, id_col, score, repeats, seed)
    return per.crossJoin(F.broadcast(base)).groupBy("feature").agg(
        F.avg(F.col("base") - F.col("auc")).alias("importance"), F.stddev_pop(F.col("base") - F.col("auc")).alias("importance_std"))


def _dealt_scores(test: DataFrame, features: list[str], label: str, id_col: str, score, repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(feature, repeat, auc) of dealt rows, and the AUC of the rows as they are, for any model."""
    test = test.checkpoint()
    n = test.count()
    base = _auc_by(score(test), label).select(F.col("auc").alias("base"))
    dealt = None
    for r in range(repeats):
        at = row_numbers(test.withColumn("_u", md5_int(F.lit(seed), F.lit(r), F.col(id_col))), [], ["_u", id_col], "_i").drop("_u")
        after = at.select((F.pmod(F.col("_i") - 2, F.lit(n)) + 1).alias("_i"), *[F.col(f).alias(f"_next_{f}") for f in features])
        x = at.join(after, "_i").checkpoint()  # every feature reads it
        for f in features:
            one = score(x.withColumn(f, F.col(f"_next_{f}"))).select(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.col(label).alias("y"), "p")
            dealt = one if dealt is None else dealt.unionByName(one)
    return M.auc(dealt, ["feature", "repeat"], "p", "y"), base


def linear_attribution(df: DataFrame, features: list[str], label: str, id_col: str) -> DataFrame:
    """Exact per-row contribution ``w_f · (z_f − mean z_f)`` of a logistic model."""
    z = standardize(df, features)
    zc = [f + "_z" for f in features]
    fit = LogisticRegression(regParam=0.01, standardization=False, featuresCol="features",
                             labelCol="label").fit(prepare(z, zc, label))
    w = [float(x) for x in fit.coefficients.toArray()]
    out = z.select(id_col, *[(F.lit(wi) * F.col(c)).alias(f) for wi, c, f in zip(w, zc, features)])
    return out.unpivot([id_col], features, "feature", "contribution")


#: Replicates whose trees grow together.
REPLICATES = 160


def bootstrap_oob_auc(df: DataFrame, features: list[str], label: str, id_col: str, n_boot: int = 2000, min_oob: int = 10, trees: int = 100) -> DataFrame:
    """H3: random-forest AUC on the out-of-bag rows of each bootstrap replicate, ``(rep, n1, n0, auc)``.

    A row counts Poisson(1) times in a replicate; rows that count zero times are out of bag.  Replicates with fewer than
    ``min_oob`` of them or with one class are left out.  The trees of ``REPLICATES`` replicates grow in the same jobs.
    """
    rows = matrix(df, id_col, label, features)
    every, out = tuple(range(len(features))), None
    for first in range(1, n_boot + 1, REPLICATES):
        models = [batch_trees.Ensemble((str(b),), every, trees=trees, depth=6, replicate=b) for b in range(first, min(first + REPLICATES, n_boot + 1))]
        pred = batch_trees.fit(rows, models, len(features)).scores(["rep"]).checkpoint()
        out = pred if out is None else out.unionByName(pred)
    return M.auc(out.withColumn("rep", F.col("rep").cast("int")), ["rep"], "p", "y").where((F.col("n1") + F.col("n0") >= min_oob) & F.col("auc").isNotNull())


def auc_interval(reps: DataFrame) -> DataFrame:
    """H3: mean and exact 2.5/97.5 percentiles of the replicates' AUC."""
    counts = reps.groupBy("auc").agg(F.count(F.lit(1)).alias("_c"))
    q = exact_quantiles(counts, [], "auc", "_c", [0.025, 0.975])
    ends = q.groupBy().agg(F.max(F.when(F.col("p") == 0.025, F.col("q"))).alias("ci_low"), F.max(F.when(F.col("p") == 0.975, F.col("q"))).alias("ci_high"))
    return reps.groupBy().agg(F.avg("auc").alias("auc_mean"), F.count(F.lit(1)).alias("n_replicates")).crossJoin(F.broadcast(ends))
