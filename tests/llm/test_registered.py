"""The registered queries: SQL oracles, the pipeline's stages, and the guard in the entry module."""
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spreadlens.llm import oracle, queries

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(oracle.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].astype(str).values.tolist())) == sorted(map(tuple, want[cols].astype(str).values.tolist()))


def test_all_operators_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(oracle.SQL) <= set(queries.QUERIES)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.collect()
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "s", 0), (-6, "password=abcdef12", "en", "s", 17)], docs.schema))
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, odd, SF)
    assert clean.columns == docs.columns and 0.8 * len(first) < clean.count() <= len(first) + 3
    once = stage["simhash_near_dedup"](spark, odd, SF)
    ids = [r["doc_id"] for r in once.collect()]
    assert len(set(ids)) == len(ids) and once.columns == docs.columns
    left = stage["decontamination"](spark, odd, SF)
    assert left.columns == docs.columns and left.count() < odd.count()
    safe = stage["secret_scans"](spark, odd, SF)
    text = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert safe.columns == docs.columns and len(text) == odd.count() and text[-6] == "[REDACTED]" and text[None] is None
    tokens = stage["bpe_tokens"](spark, odd, SF)
    assert tokens.count() == odd.count() and {r["n_tokens"] for r in tokens.collect() if r["doc_id"] in (None, -5)} == {0}
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Stages over clashing columns, one id with two unlike texts, and empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    two = docs.limit(40).union(spark.createDataFrame([(-9, "one text all of its own here", "en", "s", 0), (-9, "and quite another text for the same id", "en", "s", 0)], docs.schema))
    odd = two.selectExpr("doc_id", "text", "lang", "source", "n_chars", "lang as TEXT_", "source as fp")
    stage = dict(corpus_pipeline.STAGES)
    once = stage["simhash_near_dedup"](spark, odd, SF)
    assert once.columns == odd.columns and once.where("doc_id = -9").count() == 2
    empty = str(tmp_path)
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert stage["decontamination"](spark, odd, empty).count() == odd.count()


@pytest.mark.parametrize("gone", ["spreadlens.llm", "xxhash", "regex", "public_tokenizers"])
def test_entry_works_without_the_subpackage(gone):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith({gone!r}) or {gone!r} == "spreadlens.llm" and name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and "pipeline" not in e.queries() and "describe_lineitem" in e.queries(), "left over"
assert {gone!r} == "public_tokenizers" or not any(n.startswith("op") for n in e.queries()), "left over"
assert set(e.oracle_sql()) <= set(e.queries())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
