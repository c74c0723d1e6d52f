"""Registered queries against their DuckDB oracle on the smallest fixture."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from spreadlens.plans import oracle
from spreadlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
#: Every oracle of the reference's operators (those of the training-data operators are tested beside them).
CHECK = sorted(oracle.build())


def _norm(df):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append("~")
            elif isinstance(v, float):
                row.append(str(int(v)) if v.is_integer() else f"{v:.5f}")
            else:
                row.append(str(v.item() if hasattr(v, "item") else v))
        out.append(tuple(row))
    return sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CHECK)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    exp = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    assert _norm(got) == _norm(exp)


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    got = df.toPandas()
    sources = spark.read.parquet(f"{SF}/documents.parquet").select("source", "lang").distinct().count()
    assert 0 < len(got) <= sources and got.D_cos.between(0, 1).all() and got.prompt_id.is_unique
