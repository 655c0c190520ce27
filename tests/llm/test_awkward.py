"""Nulls in every column, repeated rows, clashing column names, tables of nothing but nulls: no crash, and the result that the docstrings name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from lorespring.llm import langid, license_scan, mixing, packing, parity_join, quality, sharding, stream_dedup, suffix_dedup, unit_dedup

OPERATORS = {
    "op1": langid.op1,
    "op2": parity_join.op2,
    "op3": lambda docs: quality.op3(docs, docs.select("doc_id", F.lit(1).alias("quality"))),
    "op4": mixing.op4,
    "op5": suffix_dedup.op5,
    "op6": unit_dedup.op6,
    "op7": stream_dedup.op7,
    "op9": license_scan.op9,
    "op10": sharding.op10,
}
KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use for themselves.
CLASHES = ["tag", "owner", "digest", "unit", "length", "piece", "start", "shard", "slot", "size", "words", "target", "taken", "kept", "n", "id", "component", "group_size", "keep_id", "count", "bucket", "grp", "score", "lang_pred"]
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, LINE, "en", "a", 5), (1, LINE, "en", "a", 5), (None, LINE, None, None, None), (None, None, None, None, None), (2, None, "en", None, 0), (3, "", None, "b", 0), (3, LINE + "\n" + LINE, "en", "b", 1), (4, "\n\n \n", "en", "b", 1), (5, "퟿￿ 😀 é", "fr", "b", 1)]
    return spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    assert OPERATORS[name](awkward).count() == awkward.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_nothing_but_nulls(spark, name):
    nulls = spark.createDataFrame([(None,) * 5] * 3, KIND)
    assert OPERATORS[name](nulls).count() == 3


def test_packing_of_awkward_rows(awkward, spark):
    assert packing.op8(awkward).count() == awkward.count()
    assert packing.op8(spark.createDataFrame([(None,) * 5] * 3, KIND)).count() == 3


def test_pipeline_stages(awkward, spark, tmp_path):
    docs = awkward
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == awkward.columns
    assert docs.count() >= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.count() == docs.count()  # short texts are one piece each
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
    nothing = spark.createDataFrame([], awkward.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, "").count() == 0


def test_results(awkward):
    kept = {(r.doc_id, r.keep_id, r.group_size) for r in stream_dedup.op7(awkward).collect()}
    assert (1, 1, 3) in kept and (None, 1, 3) in kept
    linked = {(r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in parity_join.op2(awkward).collect()}
    assert (1, 11, 2, 1) in linked and (None, 11, 2, 1) in linked and (2, 0, 0, 2) in linked
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.op5(awkward).collect()}
    n = len(LINE)
    assert cut[None, n] == 0 and cut[1, n] == n and cut[3, 2 * n + 1] == 2 * n
