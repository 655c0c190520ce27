"""Reciprocal-rank fusion of a vector leg and a keyword leg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import bm25, knn


def rrf(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (k + rank)


def fused(vector: DataFrame, keyword: DataFrame, top: int, k: int = 60, vector_weight: float = 0.5, bm25_weight: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score, vector_rank, bm25_rank, rank) of two legs (query_id, doc_id, rank). Rank 0: not in that leg. Weights are held between 0 and 1; a leg of weight 0 still gives candidates. Ties by id."""
    vw, bw = (min(max(w, 0.0), 1.0) for w in (vector_weight, bm25_weight))
    a = vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank"))
    b = keyword.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.coalesce("vector_rank", F.lit(0)).cast("int").alias("vector_rank"), F.coalesce("bm25_rank", F.lit(0)).cast("int").alias("bm25_rank"))
    part = lambda rank, w: F.when(F.col(rank) > 0, w * rrf(F.col(rank), k)).otherwise(0.0)
    scored = both.withColumn("score", F.round(part("vector_rank", vw) + part("bm25_rank", bw), 9))
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Hits that are broadcast, so that the texts that they are of needn't be shuffled.
FEW = 100_000


def content_of(hits: DataFrame, docs: DataFrame, chunks: DataFrame | None = None, few: bool = False) -> DataFrame:
    """few: there are FEW hits at most. hits with the content of their document (doc_id, content) or, where there is none, of the chunk of that id (chunk_id, content); those that have neither are dropped."""
    if few and chunks is None:
        return docs.select("doc_id", "content").where("content IS NOT NULL").join(F.broadcast(hits), "doc_id")
    found = hits.join(docs.select("doc_id", F.col("content").alias("__doc")), "doc_id", "left")
    if chunks is not None:
        found = found.join(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("__chunk")), "doc_id", "left")
    content = F.coalesce("__doc", "__chunk") if chunks is not None else F.col("__doc")
    return found.withColumn("content", content).where("content IS NOT NULL").drop("__doc", "__chunk")


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, top: int, k: int = 60, vector_weight: float = 0.5, bm25_weight: float = 0.5, words: bm25.Index | None = None, index: knn.IvfIndex | None = None) -> DataFrame:
    """fused() with content. words, index: of docs and vectors, searched where they are given and loaded, in place of all documents and vectors. docs: doc_id, text; vectors: doc_id, embedding; queries: query_id, query, embedding (null: no vector leg). Twice `top` candidates come from each leg; hits whose document is missing are dropped after the cut."""
    vector = index.search(queries, 2 * top, id_="doc_id") if index and index.loaded() else knn.top_k(queries, vectors, 2 * top, id_="doc_id")
    keyword = words.search(queries, 2 * top) if words else bm25.search(docs, queries, 2 * top)
    hits = fused(vector, keyword, top, k, vector_weight, bm25_weight)
    few = queries.limit(FEW // top + 1).count() * top <= FEW
    return content_of(hits, docs.select("doc_id", F.col("text").alias("content")), few=few).select("query_id", "doc_id", "content", "score", "vector_rank", "bm25_rank", "rank")
