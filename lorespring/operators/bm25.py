"""BM25 over an inverted index: postings and document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import bm25_tokens

K1, B = 1.2, 0.75


def tokenised(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens and doc_len. Documents without a token aren't indexed."""
    return docs.select(F.col(id_).alias("doc_id"), bm25_tokens(F.col(text)).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long")).where("doc_len > 0")


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term and tf."""
    return tokenised(docs, id_, text).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def stats(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: n documents, avgdl, total tokens."""
    return tokenised(docs, id_, text).agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"), F.sum("doc_len").alias("total"))


def removed(docs: DataFrame, gone: DataFrame, id_: str = "doc_id") -> DataFrame:
    """What stays indexed after the documents of `gone` are removed."""
    return docs.join(gone.select(id_), id_, "left_anti")


def search(docs: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query; a term that a query repeats counts each time; ties by id.

    Only tokens that some query asks for leave their document's row, already counted there.
    """
    asked = _asked(queries, query_id, query_text)
    indexed = tokenised(docs, id_, text)
    found = indexed.select("doc_id", "doc_len", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))
    return _ranked(found, indexed.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl")), asked, k, query_id)


def _inverted(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    """Lists of (term, ids, lens, tfs), sorted by term, of every `flush` tokens or so of (doc_id, doc_len, tokens). The list of the term '', which no token is, has every document."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids, lens, lists = (rows.column(i).combine_chunks() for i in range(3))
        words = lists.flatten().dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())
        pair, tf = np.unique(place[words.indices.to_numpy()] * len(ids) + row, return_counts=True)
        at = np.concatenate([np.arange(len(ids)), pair % len(ids)])
        tf = np.concatenate([np.zeros(len(ids), np.int64), tf])
        cuts = np.concatenate([[0], len(ids) + np.searchsorted(pair // len(ids), np.arange(len(order) + 1))]).astype(np.int32)
        terms = pa.concat_arrays([pa.array([""], words.dictionary.type), words.dictionary.take(pa.array(order))])
        values = (ids.take(pa.array(at)), lens.take(pa.array(at)), pa.array(tf))
        whole = pa.RecordBatch.from_arrays([terms, *[pa.ListArray.from_arrays(pa.array(cuts), v) for v in values]], names=["term", "ids", "lens", "tfs"])
        for k in range(0, whole.num_rows, 4096):
            yield whole.slice(k, 4096)

    for batch in batches:
        ends = np.cumsum(batch.column("doc_len").to_numpy())
        low = 0
        while low < batch.num_rows:
            high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + flush - size, "right")), low + 1)
            held.append(batch.slice(low, high - low))
            size += int(ends[high - 1] - (ends[low - 1] if low else 0))
            low = high
            if size >= flush or low < batch.num_rows:
                yield from out()
                size = 0
    if held:
        yield from out()


class Index:
    """The postings and lengths of a document set as a table in a folder, written once and searched often.

    Each task inverts its documents, FLUSH tokens at a time, to lists of postings by term, so nothing is shuffled, and a task holds so many tokens however large the set. Lists are sorted by
    term, so a search that asks up to FEW terms reads the pages that may have these; of more terms it reads what a join asks for. Documents that are added are more lists, those that are
    removed are tombstones; how many documents and tokens there are is counted over the lists of all documents.
    """

    FEW, FLUSH = 2000, 1 << 21
    #: Pairs of a question and a term that are broadcast.
    PAIRS = 100_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, kind: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], kind)

    def _lists(self) -> DataFrame:
        return self._read("postings", "term string, ids array<long>, lens array<long>, tfs array<long>")

    def _lengths(self) -> DataFrame:
        """doc_id and doc_len of every row that was indexed."""
        return self._lists().where("term = ''").select(F.inline(F.arrays_zip("ids", "lens")).alias("doc_id", "doc_len"))

    def _write(self, docs: DataFrame, mode: str) -> None:
        rows = tokenised(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "doc_len", "tokens")
        flush = self.FLUSH
        rows.mapInArrow(lambda b: _inverted(b, flush), "term string, ids array<long>, lens array<long>, tfs array<long>").write.mode(mode).parquet(f"{self.path}/postings")

    def build(self, docs: DataFrame, id_: str = "doc_id", text: str = "text") -> Index:
        """Replace what is there by an index of docs."""
        self.clear()
        self._write(docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")), "overwrite")
        return self

    def add(self, docs: DataFrame, id_: str = "doc_id", text: str = "text") -> Index:
        """Index the documents whose ids it doesn't have; the others stay as they are. An id that was removed can be added again after compact()."""
        new = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])
        self._write(new.join(self._lengths().select("doc_id"), "doc_id", "left_anti"), "append")
        return self

    def remove(self, gone: DataFrame, id_: str = "doc_id") -> Index:
        gone.select(F.col(id_).cast("long").alias("doc_id")).write.mode("append").parquet(f"{self.path}/removed")
        return self

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def loaded(self) -> bool:
        return len(self) > 0

    def _live(self, table: DataFrame) -> DataFrame:
        gone = self._read("removed", "doc_id long")
        return table if gone.isEmpty() else table.join(gone.distinct(), "doc_id", "left_anti")

    def __len__(self) -> int:
        """How many documents there are: an index of none isn't loaded."""
        return self._live(self._lengths()).count()

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """As search() over the documents of the index."""
        asked = _asked(queries, query_id, query_text)
        terms = [r[0] for r in asked.select("term").distinct().limit(self.FEW + 1).collect()]  # FEW + 1 words at most
        few = len(terms) <= self.FEW
        lists = self._lists().where(F.col("term").isin(terms)) if few else self._lists().join(asked.select("term").distinct(), "term", "left_semi")
        found = lists.select("term", F.inline(F.arrays_zip("ids", "lens", "tfs")).alias("doc_id", "doc_len", "tf"))
        lengths = self._lengths()
        if not lengths.groupBy("doc_id", "doc_len").count().where("count > 1").isEmpty():  # rows of one id and length are one document
            found = found.groupBy("doc_id", "doc_len", "term").agg(F.sum("tf").alias("tf"))
        totals = self._live(lengths).agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
        return _ranked(self._live(found), totals, asked, k, query_id, few and asked.limit(self.PAIRS + 1).count() <= self.PAIRS)


def _asked(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    return queries.select(query_id, F.explode(bm25_tokens(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))


def _ranked(found: DataFrame, totals: DataFrame, asked: DataFrame, k: int, query_id: str, few: bool = False) -> DataFrame:
    """few: there are so few terms and questions that these are broadcast, and postings stay where they are."""
    n_docs = found.groupBy("term").agg(F.count("*").alias("n_term"))
    if few:
        n_docs, asked = F.broadcast(n_docs), F.broadcast(asked)
    scored = found.join(n_docs, "term").join(asked, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.ln((F.col("n") - F.col("n_term") + 0.5) / (F.col("n_term") + 0.5) + 1)
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    scores = scored.groupBy(query_id, "doc_id").agg(F.round(F.sum(part * F.col("times")), 6).alias("score"))
    order = W.Window.partitionBy(query_id).orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
