"""Whole retrieval plans over a chunk table, and the presets of the chat applications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, context, hybrid, knn
from ..operators.chunk import chunked
from ..operators.compress import compressed
from ..operators.embed import Embedder
from ..functions.text import estimated_tokens, utf16_length


@dataclass(frozen=True)
class Preset:
    top_k: int = 10
    budget: int = 2000
    adjacent: int = 0
    single_source: bool = False
    strategy: str = "relevance"
    max_chars: int = 0


#: By compression level: 0 minimal, 1 balanced, 2 aggressive.
MOBILE = {level: Preset(top_k=5, budget=budget) for level, budget in enumerate((1200, 1000, 800))}
DESKTOP = {level: Preset(top_k=10, budget=4000, adjacent=2, single_source=True, max_chars=chars) for level, chars in enumerate((12000, 8000, 6000))}


def ingested(docs: DataFrame, max_chars: int, embed: Embedder, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks with embeddings of the different texts of docs: a duplicate goes before anything is chunked."""
    once = docs.where(F.col(text).isNotNull()).withColumn("__h", F.sha2(text, 256)).groupBy("__h").agg(F.min_by(F.struct(id_, text), F.col(id_)).alias("d")).select(f"d.{id_}", f"d.{text}")
    return chunked(once, max_chars, id_, text).withColumn("embedding", embed(F.col("content")))


def vector_hits(chunks: DataFrame, queries: DataFrame, k: int, index: knn.IvfIndex | None = None) -> DataFrame:
    """Hits of queries (query_id, embedding) among chunks (chunk_id, source_id, chunk_index, content, embedding): by the index of these, if one is given and loaded, else exact."""
    hits = index.search(queries, k, id_="chunk_id") if index and index.loaded() else knn.top_k(queries, chunks, k, id_="chunk_id")
    return hits.join(chunks.select("chunk_id", "source_id", "chunk_index", "content"), "chunk_id")


def search(chunks: DataFrame, queries: DataFrame, preset: Preset = Preset(), index: knn.IvfIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, contexts): nearest chunks, narrowed to the best source, then expanded, ordered, packed and rendered."""
    hits = vector_hits(chunks, queries, preset.top_k, index)
    if preset.single_source:
        hits = context.best_source_by_text(hits, queries)
    if preset.adjacent:
        hits = context.expanded(hits, chunks, preset.adjacent)
    contexts = context.context(hits, preset.budget, preset.strategy)
    if preset.max_chars:
        short = compressed(contexts.select("query_id", "text"), preset.max_chars, id_="query_id").select("query_id", F.col("text").alias("short"))
        contexts = contexts.join(short, "query_id").withColumn("text", F.col("short")).drop("short")
    return hits, contexts


def built_with_compression(hits: DataFrame, budget: int = 2000, max_chars: int = 0, strategy: str = "relevance") -> DataFrame:
    """(query_id, text, tokens, original_chars, compressed_chars, ratio, saved_percent, sentences_removed): the hits within the budget joined by their separator, without repeated sentences, cut to max_chars (0: not cut)."""
    rows = {"relevance": lambda x: x, "diverse": context.diverse, "chronological": context.chronological}[strategy](hits)
    kept = context.packed(rows, budget)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    joined = kept.groupBy("query_id").agg(F.array_join(parts, context.SEPARATOR).alias("text"))
    short = compressed(joined, max_chars, id_="query_id")
    return short.select("query_id", "text", estimated_tokens(utf16_length(F.col("text"))).alias("tokens"), "original_chars", "compressed_chars", "ratio", F.round((1 - F.col("ratio")) * 100, 4).alias("saved_percent"), "sentences_removed")


def hybrid_context(docs: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int = 10, budget: int = 2000, strategy: str = "relevance", vector_weight: float = 0.5, bm25_weight: float = 0.5, words: bm25.Index | None = None, index: knn.IvfIndex | None = None) -> DataFrame:
    """Contexts of fused hits: each document is a source with one chunk, its score the similarity."""
    hits = hybrid.search(docs, vectors, queries, top_k, vector_weight=vector_weight, bm25_weight=bm25_weight, words=words, index=index)
    as_chunks = hits.select("query_id", F.col("doc_id").alias("source_id"), F.lit(0).alias("chunk_index"), "content", F.col("score").alias("similarity"), "rank")
    return context.context(as_chunks, budget, strategy)


def prompts(queries: DataFrame, contexts: DataFrame, strict: bool = True) -> DataFrame:
    return context.prompt(queries, contexts, strict)
