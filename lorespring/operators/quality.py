"""Retrieval quality: recall@k, precision@k, pass rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall, precision, passed). hits: query_id, doc_id, rank; relevant: query_id, doc_id. Recall is by the number of relevant ones, at most k; precision by k even if fewer were found."""
    expected = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    found = hits.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    joined = expected.join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return joined.select("query_id", "hits", F.round(F.col("hits") / F.least(F.greatest("n", F.lit(1)), F.lit(k)), 6).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision"), (F.col("hits") > 0).alias("passed"))


def relevant_by_text(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Results (query_id, content) that contain one of the query's labels (query_id, label), whatever the case."""
    return results.join(labels, "query_id").where(F.contains(F.lower("content"), F.lower("label"))).select(*[results[c] for c in results.columns]).distinct()


def summary(judged_: DataFrame) -> DataFrame:
    """One row: averages and the pass rate."""
    return judged_.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), F.count("*").alias("queries"))
