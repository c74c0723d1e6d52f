import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spreadlens.sources import tables
from spreadlens.streaming import intake as S

SF = "/root/testdata/sf0.001"


def test_dedup_and_rolling_rates_stream(spark):
    src = os.path.join(SF, "events*.parquet")
    events = S.read_stream(spark, src)
    dedup = S.dedup_stream(events)
    q1 = dedup.writeStream.format("memory").queryName("dedup_out").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="ck1-", dir="/tmp")).start()
    q1.processAllAvailable()
    q1.stop()
    n = spark.sql("SELECT count(*) AS n, count(DISTINCT event_id) AS d FROM dedup_out").first()
    assert n.n == n.d > 0

    rates = S.rolling_rates(events, "event_type", F.col("value") > 10, size="1 day")
    q2 = rates.writeStream.format("memory").queryName("rates_out").outputMode("update").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="ck2-", dir="/tmp")).start()
    q2.processAllAvailable()
    q2.stop()
    got = spark.sql("SELECT sum(n) AS n FROM (SELECT window_start, event_type, max(n) AS n FROM rates_out GROUP BY 1, 2)").first().n
    assert got == spark.read.parquet(os.path.join(SF, "events.parquet")).count()


SCHEMA = "id string, prompt_id string, correctness string, correctness_score int, answer_len int, judged_at int"


def test_upsert_batches_retry_and_scores(spark):
    root = tempfile.mkdtemp(prefix="state-", dir="/tmp")
    run = S.upsert_batches(root, buckets=4)
    run(spark.createDataFrame([("a_1", "a", "correct", 5, 3, 1), ("a_2", "a", "refused", 1, 3, 1), ("b_1", "b", "correct", 5, 3, 1)], SCHEMA), 0)
    second = spark.createDataFrame([("a_2", "a", "refused", 1, 3, 1), ("a_2", "a", "incorrect", 2, 3, 2), ("a_3", "a", "correct", 4, 3, 2)], SCHEMA)
    for _ in range(2):  # the second run is a retried epoch
        run(second, 1)
        state = {r.id: r.correctness for r in S.read_state(spark, root).collect()}
        assert state == {"a_1": "correct", "a_2": "incorrect", "a_3": "correct", "b_1": "correct"}
        scores = spark.read.parquet(f"{root}/scores/epoch=1").collect()
        assert [(r.prompt_id, r.n_samples, r.n_correct) for r in scores] == [("a", 3, 2)]


def test_an_older_judgement_that_arrives_later_does_not_win(spark):
    root = tempfile.mkdtemp(prefix="late-", dir="/tmp")
    run = S.upsert_batches(root, buckets=2)
    run(spark.createDataFrame([("a_1", "a", "correct", 5, 3, 7), ("a_2", "a", "correct", 5, 3, None)], SCHEMA), 0)
    run(spark.createDataFrame([("a_1", "a", "refused", 1, 3, 6), ("a_2", "a", "refused", 1, 3, 2)], SCHEMA), 1)
    run(spark.createDataFrame([("a_2", "a", "incorrect", 2, 3, None), ("a_1", "a", "incorrect", 2, 3, 7)], SCHEMA), 2)
    got = {r.id: (r.correctness, r.judged_at) for r in S.read_state(spark, root).collect()}
    assert got == {"a_1": ("incorrect", 7), "a_2": ("refused", 2)}


def test_a_state_that_cannot_be_read_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="state-", dir="/tmp")
    run = S.upsert_batches(root, buckets=1)
    first = spark.createDataFrame([("a_1", "a", "correct", 5, 3, 1)], SCHEMA)
    run(first, 0)
    folder = f"{root}/data/v=000000001/bucket=0"
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            with open(os.path.join(folder, f), "wb") as out:
                out.write(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|malformed|corrupt"):
        run(spark.createDataFrame([("a_9", "a", "correct", 5, 3, 2)], SCHEMA), 1)


def test_versions_without_commit_are_not_read(spark):
    root = tempfile.mkdtemp(prefix="versions-", dir="/tmp")
    assert tables.read_current(spark, root) is None
    tables.write_version(spark.range(3), root, 1)
    tables.write_version(spark.range(5), root, 2)
    os.remove(f"{root}/v=000000002/_SUCCESS")
    assert tables.read_current(spark, root).count() == 3


def test_jsonl_csv_and_append(spark):
    root = tempfile.mkdtemp(prefix="files-", dir="/tmp")
    rows = spark.createDataFrame([("q_a_1", "d", "text", "correct", True, 4), ("q_a_2", "d", None, None, None, None)],
                                 "id string, dataset string, model_answer string, correctness string, adversarial boolean, correctness_score int")
    tables.append_rows(rows, f"{root}/r.jsonl")
    tables.append_rows(rows.limit(1), f"{root}/r.jsonl")
    got = tables.load_responses(spark, f"{root}/r.jsonl", ["id", "dataset"])
    assert sorted((r.id, r.prompt_id or "", r.answer_len, r.correctness_score) for r in got.collect()) == [
        ("q_a_1", "q_a", 4, 4), ("q_a_1", "q_a", 4, 4), ("q_a_2", "q_a", 0, None)]
    assert tables.load_dataframe(spark, f"{root}/r.jsonl", tables.RESPONSE_SCHEMA).count() == 3
    tables.append_rows(rows, f"{root}/r.csv", "csv")
    assert tables.load_dataframe(spark, f"{root}/r.csv").count() == 2
    with pytest.raises(ValueError, match="missing|Missing"):
        tables.load_responses(spark, f"{root}/r.jsonl", ["nothing"])
    with pytest.raises(ValueError, match="Unsupported"):
        tables.load_dataframe(spark, f"{root}/r.xlsx")


def test_vector_maps_with_and_without_wrapper(spark):
    root = tempfile.mkdtemp(prefix="maps-", dir="/tmp")
    for name, text in {"plain": '{"q1": [1.5, 2], "data": [0.25]}', "wrapped": '{"data": {"q2": [3, -4e-1], "q3": []}}'}.items():
        with open(os.path.join(root, f"{name}.json"), "w") as out:
            out.write(text)
    got = {r.id: r.vec for r in tables.load_vector_map(spark, root).collect()}
    assert got == {"q1": [1.5, 2.0], "data": [0.25], "q2": [3.0, -0.4], "q3": []}
    with open(os.path.join(root, "bad.json"), "w") as out:
        out.write('{"q4": "text"}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.load_vector_map(spark, root).collect()
