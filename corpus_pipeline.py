"""A training corpus from the documents: language ID, exact dedup, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

In every stage a null text is an empty one, a null doc_id or source is a value like any other,
rows are told apart by file and place (so rows of one doc_id with different texts are different
documents, and of wholly equal rows one may go without the other), further columns stay as they
are whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespring.llm import langid, mixing, packing, parity_join, stream_dedup
from lorespring.llm._spark import small_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, those whose language isn't told with a posterior of 1/2, and those unlike that language's own, as noise and languages that nothing was learned of. Null, empty and letterless texts go; equal texts go or stay together."""
    small_batches(spark)
    return langid.accepted(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: the one with the most code points, then the smallest doc_id (null last), then the first."""
    small_batches(spark)
    return stream_dedup.unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 5-word shingles with a Jaccard similarity of 0.8 join: the smallest doc_id (null last), then the first. Texts without words link with nothing and stay."""
    small_batches(spark)
    return parity_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words of each source that its target asks for: whole documents, once or twice, and a part of one or two a shard. Texts without words aren't taken."""
    small_batches(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the texts to tokens and packs them into sequences; a row that comes twice is packed twice."""
    small_batches(spark)
    return packing.op8(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mix), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
