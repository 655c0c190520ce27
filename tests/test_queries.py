"""Every query with SQL, against DuckDB on the driver's tables."""

from __future__ import annotations

import importlib
from pathlib import Path

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
from lorespring.plans import queries as retrieval  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(retrieval.oracle_sql()))
def test_same_as_sql(spark, tables, name):
    ours = entry.queries()[name](spark, str(SF)).toPandas()
    theirs = tables.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(retrieval.queries()) - set(retrieval.oracle_sql())))
def test_others_give_rows(spark, name):
    assert entry.queries()[name](spark, str(SF)).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pushdown(spark):
    plan = spark.read.parquet(f"{SF}/documents.parquet")
    from lorespring.operators import bm25

    text = bm25.stats(plan)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text or "ReadSchema: struct<text:string>" in text
