"""The queries over the model grid, in ANSI mode, on questions that all have one label and on questions without a dataset."""

import pytest

import __spark_entry__ as entry

BUNDLES = ["final_evaluation", "out_of_fold_bundle"]
ONE_ROW_A_MODEL = ["adaboost_auc", "boosting_holdout", "cv_model_selection", "feature_ablation"]


@pytest.fixture
def ansi(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    yield spark
    spark.conf.set("spark.sql.ansi.enabled", before)


def tables(spark, at, sources, quality):
    """Six answers to each question, one question a source, all judged as ``quality`` says of the question's number."""
    docs = [(100 * q + i, " ".join(f"w{(q * i + j) % (5 + q)}" for j in range(3 + i)), "en", s) for q, s in enumerate(sources) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    labels = [(d[0], quality(d[0] // 100), 0) for d in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def collected(spark, at, *names):
    found = entry.queries()
    return {name: found[name](spark, at).collect() for name in names}


def test_a_label_that_never_varies(ansi, tmp_path):
    """Linear models need both classes and give no scores; trees give one probability, of which there is no AUC."""
    at = tables(ansi, tmp_path, [f"src{q}" for q in range(12)], lambda q: 1)
    got = collected(ansi, at, *ONE_ROW_A_MODEL, *BUNDLES, "per_domain_clf", "per_domain_pivot", "transfer_matrix")
    assert [len(got[name]) for name in ONE_ROW_A_MODEL] == [1, 2, 3, 24]
    assert {r.roc_auc for name in ONE_ROW_A_MODEL[:2] for r in got[name]} == {None}
    assert {r.auc_mean for name in ONE_ROW_A_MODEL[2:] for r in got[name]} == {None}
    assert not any(got[name] for name in ("per_domain_clf", "per_domain_pivot", "transfer_matrix"))
    assert not any(r.part == "predictions" for name in BUNDLES for r in got[name])


def test_questions_without_a_dataset(ansi, tmp_path):
    """They count in every fold, train the models that leave a dataset out, and are a dataset nowhere."""
    sources = [f"src{q}" for q in range(20)] + [None]
    at = tables(ansi, tmp_path, sources, lambda q: int(q % 2 == 0))
    got = collected(ansi, at, *ONE_ROW_A_MODEL, *BUNDLES, "per_domain_clf", "per_domain_pivot", "transfer_matrix", "transfer_pivot", "leave_one_dataset_out")
    assert [len(got[name]) for name in ONE_ROW_A_MODEL] == [1, 2, 5, 40]
    names = {f"ds{i}" for i in range(5)}
    assert {(r.train, r.test) for r in got["transfer_matrix"]} == {(a, b) for a in names for b in names}
    assert {r.train for r in got["transfer_pivot"]} == names == set(got["transfer_pivot"][0].asDict()) - {"train"}
    # 21 questions, of which four have the dataset that is left out
    assert {(r.held_out, r.n_train, r.n_test) for r in got["leave_one_dataset_out"]} == {(d, 17, 4) for d in names}
    assert len({r.place for r in got["out_of_fold_bundle"] if r.part == "predictions"}) == 21
