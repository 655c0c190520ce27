"""Compression: repeated sentences go, then the text is cut to a length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import TERMINATORS, normal_sentence, sentences
from ..functions.vectors import cosine_in_batches
from . import knn


def compressed(docs: DataFrame, max_chars: int = 0, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id, text, original_chars, compressed_chars, ratio, sentences_removed and chars_saved_truncation. Characters are code points; max_chars 0: not cut. An empty text has ratio 1.

    Sentences are numbered and grouped within their row, so the only work is in the row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_), whole.alias("whole"), sentences(whole).alias("ss"))
    # of equal normal forms the first place: forms sorted with their places, one pass over neighbours
    placed = F.array_sort(F.transform("ss", lambda s, i: F.struct(normal_sentence(s).alias("n"), i.alias("i"))))
    rows = rows.withColumn("__placed", placed).withColumn("__first", F.expr("array_sort(transform(filter(__placed, (x, k) -> k = 0 OR x.n <> __placed[k - 1].n), x -> x.i))"))
    rows = rows.withColumn("kept", F.transform("__first", lambda i: F.get(F.col("ss"), i))).withColumn("joined", F.array_join("kept", " "))
    cut = F.substring("joined", 1, max_chars)
    ended = F.regexp_extract(cut, f"(?s)^(.*[{TERMINATORS}])", 1)
    final = F.when(F.length("joined") > max_chars, F.when(ended != "", ended).otherwise(cut)).otherwise(F.col("joined")) if max_chars > 0 else F.col("joined")
    rows = rows.withColumn("final", final)
    n = F.length("whole")
    return rows.select(id_, F.col("final").alias("text"), n.cast("long").alias("original_chars"), F.length("final").cast("long").alias("compressed_chars"), F.when(n == 0, 1.0).otherwise(F.round(F.length("final") / F.greatest(n, F.lit(1)), 6)).alias("ratio"), (F.size("ss") - F.size("kept")).cast("long").alias("sentences_removed"), (F.length("joined") - F.length("final")).cast("long").alias("chars_saved_truncation"))


def repeated_sentences(docs: DataFrame, text: str = "text", id_: str = "doc_id", shown: int = 3, preview: int = 60) -> DataFrame:
    """id, sentence (its first 60 characters) and times of the sentences that a text has more than once: its first `shown`, most frequent first."""
    rows = docs.select(F.col(id_), F.explode(sentences(F.col(text))).alias("s")).groupBy(id_, "s").agg(F.count("*").alias("times")).where("times > 1")
    order = W.Window.partitionBy(id_).orderBy(F.desc("times"), "s")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown).select(id_, "place", F.substring("s", 1, preview).alias("sentence"), "times")


def scored_sentences(texts: DataFrame, queries: DataFrame, embed, top: int = 10, least: float = 0.2) -> DataFrame:
    """(query_id, index, sentence, similarity): sentences of each query's text (query_id, text) by cosine to its embedding. embed: column of text -> column of vector."""
    parts = texts.select("query_id", F.posexplode(sentences(F.col("text"))).alias("index", "sentence")).where(F.trim("sentence") != "")
    scored = parts.join(queries.select("query_id", "embedding"), "query_id").withColumn("similarity", F.round(cosine_in_batches(embed(F.col("sentence")), F.col("embedding")), 6)).where(F.col("similarity") >= least)
    order = W.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "index")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("query_id", "index", "sentence", "similarity", "place")


def compressed_by_similarity(texts: DataFrame, queries: DataFrame, embed, top: int = 15, least: float = 0.2) -> DataFrame:
    """(query_id, text, ...) of compressed() over the best sentences of each query's text, in their order."""
    best = scored_sentences(texts, queries, embed, top, least)
    joined = best.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    return compressed(joined, 0, "text", "query_id")


def _against_all(parts: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """parts with query_id and similarity in place of the vector __v, a row a query. Queries of a size that can be sent to the workers are held against a batch of vectors at once, where these are made, and only what is about as similar as `least` leaves it."""
    asked = knn._sent(queries, "query_id", "embedding") if least > 0 and dict(queries.dtypes)["query_id"] in ("int", "bigint") else None
    if asked is None:
        pairs = parts.crossJoin(queries.select("query_id", "embedding"))
        return pairs.withColumn("similarity", F.round(cosine_in_batches(F.col("__v"), F.col("embedding")), 6)).drop("__v", "embedding")
    shared = queries.sparkSession.sparkContext.broadcast(asked)

    @F.pandas_udf("q array<long>, s array<double>")
    def scores(vectors: pd.Series) -> pd.DataFrame:
        sizes = np.array([0 if v is None else len(v) for v in vectors], np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for dim, (ids, data) in shared.value.items():
            mine = np.flatnonzero(sizes == dim)
            if not len(mine):
                continue
            x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in mine])
            norms = np.sqrt((x * x).sum(1))
            for q, y, norm in zip(ids.tolist(), data, np.sqrt((data * data).sum(1))):
                both = norms * norm
                similarity = np.divide((x * y).sum(1), both, out=np.zeros(len(x)), where=both > 0)
                hit = np.flatnonzero(~(similarity < least - 1e-6))
                found.append((mine[hit], np.full(len(hit), q), similarity[hit]))
        row, q, s = (np.concatenate(f) for f in zip(*found))
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(1, len(sizes)))
        return pd.DataFrame({"q": np.split(q[order], cuts)[: len(sizes)], "s": np.split(s[order], cuts)[: len(sizes)]})

    every = parts.withColumn("__s", scores(F.col("__v"))).drop("__v")
    kind = dict(queries.dtypes)["query_id"]
    hits = every.select(*every.columns[:-1], F.inline(F.arrays_zip(F.col("__s.q").alias("q"), F.col("__s.s").alias("s"))).alias("query_id", "similarity"))
    return hits.withColumn("query_id", F.col("query_id").cast(kind)).withColumn("similarity", F.round("similarity", 6))


def compressed_for_queries(docs: DataFrame, queries: DataFrame, embed, top: int = 15, least: float = 0.2, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(query_id, id, text, ...) of compressed() over the sentences of each text that are nearest to each query (query_id, embedding), in their order. A sentence is embedded once, whatever is asked of it; every query is held against every text."""
    parts = docs.select(F.col(id_), F.posexplode(sentences(F.col(text))).alias("index", "sentence")).where(F.trim("sentence") != "").withColumn("__v", embed(F.col("sentence")))
    scored = _against_all(parts, queries, least).where(F.col("similarity") >= least)
    order = W.Window.partitionBy("query_id", id_).orderBy(F.desc("similarity"), "index")
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    joined = best.groupBy("query_id", id_).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    short = compressed(joined.select(F.struct("query_id", id_).alias("key"), "text"), 0, "text", "key")
    return short.select("key.query_id", f"key.{id_}", *[c for c in short.columns if c != "key"])
