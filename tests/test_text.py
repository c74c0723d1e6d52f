from pyspark.sql import functions as F

from spreadlens.functions import text as TX


def test_domain_consolidation_order_and_default(spark):
    df = spark.createDataFrame([("STEM Science",), ("natural science",), ("Pop culture",), ("cooking",),
                                ("unrelated",), (None,)], "d string")
    got = [r[0] for r in df.select(TX.consolidate_domain("d")).collect()]
    assert got == ["STEM", "Science", "Entertainment", "Food & Nutrition", "Other", "Other"]


def test_answer_extractors(spark):
    df = spark.createDataFrame([("so \\boxed{42} and \\boxed{7}", "x #### 12 ", "  Paris\nQuestion: next")], "a string, b string, c string")
    r = df.select(TX.extract_boxed("a").alias("a"), TX.extract_after_hashes("b").alias("b"),
                  TX.clean_answer("c").alias("c")).first()
    assert (r.a, r.b, r.c) == ("42", "12", "Paris")


def test_judge_parse_defaults_and_errors(spark):
    df = spark.createDataFrame([('{"correctness": "Correct", "correctness_score": 5}',), ('{"domain": "STEM"}',),
                                ('{"correctness": tru',), (None,)], "c string")
    p = TX.parse_judgement("c")
    rows = df.select(*[v.alias(k) for k, v in p.items()]).collect()
    assert (rows[0].correctness, rows[0].correctness_score, rows[0].adversarial) == ("correct", 5, False)
    assert (rows[1].correctness, rows[1].domain, rows[1].correctness_score) == ("unknown", "STEM", -1)
    assert rows[2].correctness == "error" and rows[3].correctness == "error"


def test_judge_fields_of_any_json_type(spark):
    df = spark.createDataFrame([('{"correctness": "CORRECT", "adversarial": "true", "correctness_score": "4"}',),
                                ('{"correctness": null, "adversarial": true, "correctness_score": 4.0}',),
                                ('["correct"]',), ('{"correctness_score": "many", "adversarial": 1}',)], "c string")
    rows = [tuple(r) for r in df.select(*[v.alias(k) for k, v in TX.parse_judgement("c").items()]).collect()]
    assert rows == [("correct", "unknown", True, 4), ("unknown", "unknown", True, 4), ("error", "error", False, -1), ("unknown", "unknown", False, -1)]


def test_judge_prompt_is_whole():
    assert TX.JUDGE_PROMPT.count("Question: ") == 5 and TX.JUDGE_PROMPT.count('Correctness: "refused"') == 2
    assert [TX.JUDGE_PROMPT.index(f"{i}. ") for i in range(1, 5)] == sorted(TX.JUDGE_PROMPT.index(f"{i}. ") for i in range(1, 5))


def test_words_of_any_script_are_embedded(spark):
    from spreadlens.sources import fixtures as FX
    df = spark.createDataFrame([("a", "日本語 テキスト"), ("b", "Ünïcode 42"), ("c", "--- !!"), ("d", None)], "id string, model_answer string")
    py = {r.id: r.e for r in FX.text_vectors(df).collect()}
    sql = {r.id: r.e for r in FX.text_vectors_sql(df).collect()}
    assert set(py) == set(sql) == set("abcd")
    assert all(abs(x - y) < 1e-12 for i in py for x, y in zip(py[i], sql[i], strict=True))
    assert any(py["a"]) and not any(py["c"]) and not any(py["d"])


def test_identity_format(spark):
    df = spark.createDataFrame([("mmlu", 7, 0.1, 3)], "d string, i int, t double, a int")
    r = df.select(TX.prompt_identity("d", "i", "t").alias("p")).select(
        "p", TX.answer_identity(F.col("p"), F.lit(3)).alias("id")).first()
    assert r.p == "mmlu_00007_t0.1" and r.id == "mmlu_00007_t0.1_ans03"
