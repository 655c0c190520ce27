"""One query per retrieval operator over the driver's tables, and the same in SQL.

`embeddings` are vectors of the documents with the same id, their `label` is a source;
lines of documents are chunks; `benchmark` texts are questions. Query sets are the rows
whose id is divisible by 50, searched against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import bm25, chunk, compress, context, embed, hybrid, knn, quality
from ..sources import scratch, store
from ..streaming import incremental
from . import service

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def _register(name: str, sql: str | None) -> Callable[[Callable], Callable]:
    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        tables = function.__code__.co_varnames[: function.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(**{t: spark if t == "spark" else sf_dir if t == "sf_dir" else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

        _found[name] = (run, sql)
        return function

    return add


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _fill(sql: str, **parts: object) -> str:
    """sql with {name} replaced by each part; other braces stay."""
    for name, part in parts.items():
        sql = sql.replace("{" + name + "}", str(part))
    return sql


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# store


@_register("doc_dedup_sha256", """
SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS source_id,
  doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS is_duplicate FROM documents""")
def _(documents):
    return store.deduplicated(documents)


@_register("dedup_anti_join", """
SELECT DISTINCT sha256(text) AS content_hash, text AS content FROM conversations
WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)""")
def _(conversations, documents):
    return store.unseen(conversations, documents)


@_register("hash_migration", "SELECT doc_id AS id, text AS content, sha256(text) AS content_hash FROM documents")
def _(documents):
    return store.with_hash(documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


_LINES = """lines AS (SELECT doc_id AS source_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS parts FROM documents),
chunks AS (SELECT source_id, CAST(unnest(range(len(parts))) AS INT) AS chunk_index, unnest(parts) AS content FROM lines)"""


@_register("source_lines", f"WITH {_LINES} SELECT source_id, chunk_index, content FROM chunks")
def _(documents):
    return store.lines(documents)


@_register("adjacent_range", f"WITH {_LINES} SELECT source_id, chunk_index, content, CAST(0 AS DOUBLE) AS similarity FROM chunks WHERE chunk_index BETWEEN 1 AND 3")
def _(documents):
    return store.in_range(store.lines(documents), 1, 3)


@_register("store_stats", f"WITH {_LINES} SELECT (SELECT count(DISTINCT text) FROM documents) AS source_count, (SELECT count(*) FROM chunks) AS chunk_count")
def _(documents):
    sources = documents.where("text IS NOT NULL").select(tx.content_hash(F.col("text")).alias("h")).distinct()
    return sources.agg(F.count("*").alias("source_count")).crossJoin(store.lines(documents).agg(F.count("*").alias("chunk_count")))


@_register("doc_count", "SELECT count(*) AS n FROM documents")
def _(documents):
    return documents.agg(F.count("*").alias("n"))


@_register("delete_source", f"WITH {_LINES} SELECT source_id, count(*) AS n FROM chunks WHERE source_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source_id")
def _(documents, labels):
    gone = labels.where("toxic = 1").select(F.col("doc_id").alias("source_id")).distinct()
    return store.without_sources(store.lines(documents), gone).groupBy("source_id").agg(F.count("*").alias("n"))


@_register("text_preview", "SELECT doc_id, substr(text, 1, 100) AS preview FROM documents")
def _(documents):
    return documents.select("doc_id", tx.truncated(F.col("text"), 100).alias("preview"))


# vectors


@_register("cosine_pairs", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(embeddings):
    other = embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return embeddings.join(other, embeddings["vec_id"] == other["a"]).select("a", "b", F.round(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@_register("cosine_edge_cases", f"""
WITH v AS (SELECT vec_id, {_DOUBLES} AS a FROM embeddings),
p AS (SELECT vec_id, 'zero' AS name, a, list_transform(a, lambda x: 0.0::DOUBLE) AS b FROM v UNION ALL SELECT vec_id, 'same', a, a FROM v UNION ALL SELECT vec_id, 'opposite', a, list_transform(a, lambda x: -x) FROM v
 UNION ALL SELECT vec_id, 'lengths', a, a[1:3] FROM v UNION ALL SELECT vec_id, 'empty', a[1:0], a[1:0] FROM v UNION ALL SELECT vec_id, 'reversed', a, list_reverse(a) FROM v),
s AS (SELECT vec_id, name, CASE WHEN len(a) <> len(b) OR len(a) = 0 THEN 0.0 WHEN list_sum(list_transform(b, lambda x: x * x)) = 0 OR list_sum(list_transform(a, lambda x: x * x)) = 0 THEN 0.0 ELSE round(list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 6) END AS similarity FROM p)
SELECT vec_id, name, similarity, round(1 - similarity, 6) AS distance FROM s""")
def _(embeddings):
    a = F.col("embedding")
    other = {"zero": F.transform(a, lambda x: x * 0), "same": a, "opposite": F.transform(a, lambda x: -x), "lengths": F.slice(a, 1, 3), "reversed": F.reverse(a)}
    pairs = [F.struct(F.lit(n).alias("name"), a.alias("a"), b.cast("array<float>").alias("b")) for n, b in other.items()]
    none = F.array().cast("array<float>")
    rows = embeddings.select("vec_id", F.explode(F.array(*pairs, F.struct(F.lit("empty").alias("name"), none.alias("a"), none.alias("b")))).alias("p")).select("vec_id", "p.*")
    similarity = F.round(vx.cosine(F.col("a"), F.col("b")), 6)
    return rows.select("vec_id", "name", similarity.alias("similarity"), F.round(vx.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@_register("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def _(embeddings):
    return embeddings.select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"))


_SIMS = """sims AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q, embeddings v WHERE {where})"""
_KNN = "WITH " + _SIMS + """, r AS (SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM sims {least})
SELECT * FROM r WHERE rank <= {k}"""


def _asked(embeddings: DataFrame) -> DataFrame:
    return embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@_register("knn_exact_topk", _KNN.format(where="q.vec_id % 50 = 0", least="", k=3))
def _(embeddings):
    return knn.top_k(_asked(embeddings), embeddings, 3)


@_register("knn_batch_topk", _KNN.format(where="q.vec_id % 50 = 0", least="", k=10))
def _(embeddings):
    return knn.top_k(_asked(embeddings), embeddings, 10)


@_register("knn_min_similarity", _KNN.format(where="q.vec_id % 50 = 0", least="WHERE similarity >= 0.2", k=15))
def _(embeddings):
    return knn.top_k(_asked(embeddings), embeddings, 15, least=0.2)


_indexes: dict[tuple, object] = {}


def _once(kind: type, table: DataFrame, build: Callable):
    """The index over a table: built when it is first asked for, then kept as tables in the shared folder for as long as the application runs and the table's files are the same."""
    key = (kind, table.sparkSession.sparkContext.applicationId, tuple(sorted(table.inputFiles())))
    if key not in _indexes:
        _indexes[key] = build(kind(table.sparkSession, scratch.new_folder(table.sparkSession, kind.__name__)))
    return _indexes[key]


def _near(embeddings: DataFrame) -> knn.IvfIndex:
    return _once(knn.IvfIndex, embeddings, lambda i: i.build(embeddings))


def _words(documents: DataFrame) -> bm25.Index:
    return _once(bm25.Index, documents, lambda i: i.build(documents))


@_register("knn_ivf", None)
def _(embeddings):
    return _near(embeddings).search(_asked(embeddings), 10)


@_register("knn_ivf_all_cells", _KNN.format(where="q.vec_id % 50 = 0", least="", k=10))
def _(embeddings):
    """The index, asked to look at every cell: the exact result."""
    return _near(embeddings).search(_asked(embeddings), 10, probes=knn.IvfIndex.MOST_CELLS)


# keyword search

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{L}\p{N}_]+'), lambda x: strlen(x) >= 2)"
_INDEX = f"""tokens AS (SELECT doc_id, {_fill(_TOKENS, c='text')} AS ts FROM documents{{where}}),
indexed AS (SELECT doc_id, ts, len(ts) AS dl FROM tokens WHERE len(ts) > 0),
postings AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS term FROM indexed) GROUP BY ALL),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM indexed)"""
_BM25 = "WITH " + _INDEX + f""", asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_fill(_TOKENS, c='text')}) AS term FROM benchmark WHERE item_id {{q}}) GROUP BY ALL),
df AS (SELECT term, count(*) AS n_term FROM postings GROUP BY term),
scores AS (SELECT query_id, doc_id, round(sum(times * ln((n - n_term + 0.5) / (n_term + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM postings JOIN asked USING (term) JOIN df USING (term), totals GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores)"""
_TOXIC = " WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def _questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@_register("bm25_tokens", f"SELECT doc_id, CAST(len({_fill(_TOKENS, c='text')}) AS BIGINT) AS n_tokens, CAST(list_unique({_fill(_TOKENS, c='text')}) AS BIGINT) AS n_terms FROM documents")
def _(documents):
    t = tx.bm25_tokens(F.col("text"))
    return documents.select("doc_id", _long(F.size(t)).alias("n_tokens"), _long(F.size(F.array_distinct(t))).alias("n_terms"))


@_register("bm25_postings", "WITH " + _fill(_INDEX, where="") + " SELECT doc_id, term, tf FROM postings")
def _(documents):
    return bm25.postings(documents)


@_register("bm25_stats", "WITH " + _fill(_INDEX, where="") + " SELECT count(*) AS n, round(avg(dl), 6) AS avgdl, CAST(sum(dl) AS BIGINT) AS total FROM indexed")
def _(documents):
    return bm25.stats(documents).withColumn("avgdl", F.round("avgdl", 6))


@_register("bm25_search", _fill(_BM25, where="", q="% 50 = 0") + " SELECT * FROM bm WHERE rank <= 3")
def _(documents, benchmark):
    return _words(documents).search(_questions(benchmark), 3)


@_register("bm25_index_add", _fill(_BM25, where=_TOXIC, q="% 50 = 0") + " SELECT * FROM bm WHERE rank <= 10")
def _(spark, documents, benchmark, labels):
    """An index of the documents with odd ids, to which all are added and from which some are removed."""
    index = bm25.Index(spark, scratch.new_folder(spark, "words")).build(documents.where("doc_id % 2 = 1"))
    return index.add(documents).remove(labels.where("toxic = 1").distinct()).search(_questions(benchmark), 10)


@_register("bm25_batch", _fill(_BM25, where="", q="% 50 = 0") + " SELECT * FROM bm WHERE rank <= 10")
def _(documents, benchmark):
    return bm25.search(documents, _questions(benchmark), 10)


@_register("bm25_after_remove", _fill(_BM25, where=_TOXIC, q="% 50 = 0") + " SELECT * FROM bm WHERE rank <= 10")
def _(documents, benchmark, labels):
    left = bm25.removed(documents, labels.where("toxic = 1").distinct())
    return bm25.search(left, _questions(benchmark), 10)


# fusion

_LEGS = _fill(_BM25, where="", q="% 50 = 0") + """, sims AS (SELECT b.item_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS s
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v WHERE b.item_id % 50 = 0{vector}),
vec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM sims),
fused AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id, CAST(coalesce(v.rank, 0) AS INT) AS vector_rank, CAST(coalesce(k.rank, 0) AS INT) AS bm25_rank
  FROM (SELECT * FROM vec WHERE rank <= 20) v FULL JOIN (SELECT * FROM bm WHERE rank <= 20) k ON v.query_id = k.query_id AND v.doc_id = k.doc_id),
scored AS (SELECT *, round(CASE WHEN vector_rank > 0 THEN {vw} / (60 + vector_rank) ELSE 0 END + CASE WHEN bm25_rank > 0 THEN {bw} / (60 + bm25_rank) ELSE 0 END, 9) AS score FROM fused),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored),
hits AS (SELECT query_id, t.doc_id, d.text AS content, CAST(score AS DOUBLE) AS score, vector_rank, bm25_rank, rank FROM top t JOIN documents d ON d.doc_id = t.doc_id WHERE rank <= 10)"""


def _legs(vw: float, bw: float, vector: str = "") -> str:
    return _fill(_LEGS, vw=f"CAST({vw} AS DOUBLE)", bw=f"CAST({bw} AS DOUBLE)", vector=vector)


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


def _both(benchmark: DataFrame, embeddings: DataFrame) -> DataFrame:
    return _questions(benchmark).join(embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def _hybrid(documents, embeddings, benchmark, vw=0.5, bw=0.5) -> DataFrame:
    return hybrid.search(documents, _vectors(embeddings), _both(benchmark, embeddings), 10, vector_weight=vw, bm25_weight=bw, words=_words(documents))


@_register("rrf_hybrid", _legs(0.5, 0.5) + " SELECT * FROM hits")
def _(documents, embeddings, benchmark):
    return _hybrid(documents, embeddings, benchmark)


@_register("rrf_weighted_1_0", _legs(1.0, 0.0) + " SELECT * FROM hits")
def _(documents, embeddings, benchmark):
    return _hybrid(documents, embeddings, benchmark, 1.7, -0.5)  # held between 0 and 1


@_register("rrf_weighted_3_7", _legs(0.3, 0.7) + " SELECT * FROM hits")
def _(documents, embeddings, benchmark):
    return _hybrid(documents, embeddings, benchmark, 0.3, 0.7)


@_register("rrf_missing_leg", _legs(0.5, 0.5, " AND false") + " SELECT * FROM hits")
def _(documents, benchmark):
    asked = _questions(benchmark).withColumn("embedding", F.lit(None).cast("array<float>"))
    return hybrid.search(documents, documents.select("doc_id", F.lit(None).cast("array<float>").alias("embedding")), asked, 10)


# context

# Hits: the 10 best vectors of each query; an embedding's label is its source, its id its place, its document's text the content.
_HITS = "WITH " + _SIMS.format(where="q.vec_id % 50 = 0") + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims),
hits AS (SELECT query_id, CAST(label AS BIGINT) AS source_id, vec_id AS chunk_index, d.text AS content, similarity, rank FROM ranked JOIN documents d ON d.doc_id = vec_id WHERE rank <= 10)"""


def _hits(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    best = knn.top_k(_asked(embeddings), embeddings, 10)
    return best.join(embeddings.select("vec_id", "label"), "vec_id").join(documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id").select("query_id", _long("label").alias("source_id"), F.col("vec_id").alias("chunk_index"), "content", "similarity", _long("rank").alias("rank"))


_BRIEF = ["query_id", "source_id", "chunk_index", "similarity", "rank"]


def _brief(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "source_id", "chunk_index", "similarity", _long("rank").alias("rank"))


@_register("adjacent_expand", f"""WITH {_LINES}, hits AS (SELECT doc_id AS query_id, doc_id AS source_id, 2 AS at FROM documents UNION ALL SELECT doc_id, doc_id, 5 FROM documents),
band AS (SELECT h.query_id, c.source_id, c.chunk_index, max(CASE WHEN c.chunk_index = h.at THEN 0.5 ELSE 0 END) AS similarity FROM hits h JOIN chunks c ON c.source_id = h.source_id AND c.chunk_index BETWEEN greatest(h.at - 2, 0) AND h.at + 2 GROUP BY ALL)
SELECT query_id, source_id, chunk_index, CAST(similarity AS DOUBLE) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY source_id, chunk_index) AS rank FROM band""")
def _(documents):
    # of every document, its third and sixth line are hits of a query of its own
    lines = store.lines(documents)
    hits = documents.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("source_id"), F.explode(F.array(F.lit(2), F.lit(5))).alias("chunk_index"), F.lit(0.5).alias("similarity"))
    return _brief(context.expanded(hits, lines, 2))


@_register("single_source_score", _HITS + """, sums AS (SELECT query_id, source_id, round(sum(similarity), 6) AS total, min(rank) AS seen FROM hits GROUP BY ALL),
win AS (SELECT query_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, seen) AS r FROM sums WHERE total > -1) WHERE r = 1)
SELECT query_id, source_id, chunk_index, similarity, rank FROM hits JOIN win USING (query_id, source_id)""")
def _(embeddings, documents):
    return _brief(context.best_source_by_score(_hits(embeddings, documents)))


@_register("single_source_text", _legs(0.5, 0.5) + r""", words AS (SELECT item_id AS query_id, lower(text) AS whole, list_filter(regexp_split_to_array(lower(text), '[\s()]+'), lambda w: length(w) > 2) AS ws FROM benchmark WHERE item_id % 50 = 0),
pts AS (SELECT h.query_id, d.source AS source, h.rank, h.score, len(list_filter(ws, lambda w: contains(lower(h.content), w))) + CASE WHEN contains(lower(h.content), whole) THEN 100 ELSE 0 END AS p FROM hits h JOIN documents d USING (doc_id) JOIN words USING (query_id)),
sums AS (SELECT query_id, source, sum(p) AS total, min(rank) AS seen FROM pts GROUP BY ALL),
win AS (SELECT query_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, seen) AS r FROM sums WHERE total > 0) WHERE r = 1)
SELECT h.query_id, h.doc_id, d.source AS source_id, CAST(h.rank AS BIGINT) AS rank FROM hits h JOIN documents d USING (doc_id) JOIN win ON win.query_id = h.query_id AND win.source = d.source""")
def _(documents, embeddings, benchmark):
    hits = _hybrid(documents, embeddings, benchmark).join(documents.select("doc_id", F.col("source").alias("source_id")), "doc_id").withColumn("similarity", F.col("score"))
    return context.best_source_by_text(hits, _questions(benchmark)).select("query_id", "doc_id", "source_id", _long("rank").alias("rank"))


@_register("diverse_sources", "WITH RECURSIVE " + _HITS.removeprefix("WITH ") + """, lists AS (SELECT query_id, list(struct_pack(r := rank, s := source_id, c := chunk_index) ORDER BY rank) AS l FROM hits GROUP BY query_id),
fold(query_id, todo, pick, n) AS (SELECT query_id, l, NULL::STRUCT(r BIGINT, s BIGINT, c BIGINT), 0 FROM lists
 UNION ALL SELECT query_id, list_filter(todo, lambda x: x.r <> p.r), p, n + 1 FROM (SELECT query_id, todo, n, coalesce(list_filter(todo, lambda x: pick IS NULL OR x.s <> pick.s)[1], todo[1]) AS p FROM fold WHERE len(todo) > 0))
SELECT query_id, pick.s AS source_id, pick.c AS chunk_index, CAST(n AS BIGINT) AS rank FROM fold WHERE n > 0""")
def _(embeddings, documents):
    return context.diverse(_hits(embeddings, documents)).select("query_id", "source_id", "chunk_index", _long("rank").alias("rank"))


@_register("chronological", _HITS + " SELECT query_id, source_id, chunk_index, similarity, row_number() OVER (PARTITION BY query_id ORDER BY source_id, chunk_index) AS rank FROM hits")
def _(embeddings, documents):
    return _brief(context.chronological(_hits(embeddings, documents)))


_PACKED = """, steps AS (SELECT *, CAST(ceil(length(content) / 4) AS BIGINT) + CASE WHEN row_number() OVER w > 1 THEN 2 ELSE 0 END AS step FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
packed AS (SELECT * FROM (SELECT *, CAST(sum(step) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS tokens FROM steps) WHERE tokens <= 2000)"""
_TEXT = """, bodies AS (SELECT query_id, source_id, min(rank) AS first, max(tokens) AS tokens, count(*) AS n, '=== Document ' || source_id || ' ===' || chr(10) || chr(10) || string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM packed GROUP BY query_id, source_id),
texts AS (SELECT query_id, string_agg(t, chr(10) || chr(10) || repeat('=', 10) || ' DIFFERENT DOCUMENT ' || repeat('=', 10) || chr(10) || chr(10) ORDER BY first) AS text, max(tokens) AS tokens, CAST(sum(n) AS BIGINT) AS n_chunks FROM bodies GROUP BY query_id)"""
_PROMPT = f"'{context.STRICT}' || chr(10) || chr(10) || '--- Documents ---' || chr(10) || text || chr(10) || '--- End of documents ---' || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:'"


@_register("budget_pack", _HITS + _PACKED + " SELECT query_id, source_id, chunk_index, tokens, rank FROM packed")
def _(embeddings, documents):
    return context.packed(_hits(embeddings, documents), 2000).select("query_id", "source_id", "chunk_index", "tokens", "rank")


@_register("grouped_text", _HITS + _PACKED + _TEXT + " SELECT * FROM texts")
def _(embeddings, documents):
    return context.grouped_text(context.packed(_hits(embeddings, documents), 2000))


@_register("prompt", _HITS + _PACKED + _TEXT + f", q AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)) SELECT query_id, CASE WHEN text IS NULL THEN query ELSE {_PROMPT.replace('text ||', 'texts.text ||')} END AS prompt FROM q LEFT JOIN texts USING (query_id)")
def _(embeddings, documents):
    hits = _hits(embeddings, documents)
    asked = documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")).join(_asked(embeddings).select("query_id"), "query_id", "left_semi")
    return context.prompt(asked, context.context(hits))


_HYBRID_CONTEXT = _legs(0.5, 0.5).replace("hits AS (SELECT", "found AS (SELECT") + ", hits AS (SELECT query_id, doc_id AS source_id, 0 AS chunk_index, content, score AS similarity, rank FROM found)" + _PACKED + _TEXT


@_register("hybrid_with_context", _HYBRID_CONTEXT + " SELECT query_id, text, tokens, n_chunks, 2000 - tokens AS remaining_budget FROM texts")
def _(documents, embeddings, benchmark):
    return service.hybrid_context(documents, _vectors(embeddings), _both(benchmark, embeddings), words=_words(documents))


@_register("hybrid_prompt", _HYBRID_CONTEXT + f", q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 50 = 0) SELECT query_id, CASE WHEN texts.text IS NULL THEN query ELSE {_PROMPT.replace('text ||', 'texts.text ||')} END AS prompt FROM q LEFT JOIN texts USING (query_id)")
def hybrid_prompt(documents, embeddings, benchmark):
    return service.prompts(_questions(benchmark), service.hybrid_context(documents, _vectors(embeddings), _both(benchmark, embeddings), words=_words(documents)))


@_register("mock_answer", _HITS + """, l AS (SELECT query_id, rank, rank || '. ' || CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS line FROM hits WHERE rank <= 3)
SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS answer FROM l GROUP BY query_id""")
def _(embeddings, documents):
    return context.mock_answer(_hits(embeddings, documents))


@_register("chat_history_last10", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10")
def _(conversations):
    return context.last_messages(conversations).select("conv_id", "turn", "role", "text")


@_register("chat_messages", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
h AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS t FROM r WHERE r <= 10 GROUP BY conv_id)
SELECT conv_id, 'system: Answer helpfully.' || chr(10) || t || chr(10) || 'user: And then?' AS said FROM h""")
def _(conversations):
    """Every conversation, asked on: the system's message, its last ten and the question."""
    asked = conversations.select(F.col("conv_id").alias("query_id")).distinct().withColumn("query", F.lit("And then?"))
    none = asked.select("query_id", F.lit(None).cast("string").alias("text")).where("false")
    history = conversations.select(F.col("conv_id").alias("query_id"), "turn", "role", "text")
    said = context.messages(asked, none, history)
    return said.select(F.col("query_id").alias("conv_id"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("said"))


def _chat(documents: DataFrame, benchmark: DataFrame, preset: service.Preset) -> DataFrame:
    embedder = embed.hashing(64)
    chunks = service.ingested(documents, 1000, embedder).withColumn("chunk_id", F.col("source_id") * 1_000_000 + F.col("chunk_index"))
    asked = _questions(benchmark).withColumn("embedding", embedder(F.col("query")))
    _, contexts = service.search(chunks, asked, preset)
    return service.prompts(asked, contexts)


@_register("desktop_chat", None)
def _(documents, benchmark):
    """Chunks, embeddings, search, best source, neighbours, packing, compression and prompt in one plan."""
    return _chat(documents, benchmark, service.DESKTOP[1])


@_register("mobile_chat", None)
def _(documents, benchmark):
    return _chat(documents, benchmark, service.MOBILE[1])


# sentences and compression

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"
_TRIM = rf"regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')"
_SENTENCES = rf"list_filter(list_transform(regexp_extract_all(coalesce({{c}}, ''), '[^.?!。]*[.?!。]|[^.?!。]+'), lambda x: {_TRIM}), lambda x: strlen(x) > 1 OR (x <> '' AND NOT regexp_matches(x, '[.?!。]$')))"
_NORMAL = rf"regexp_replace(regexp_replace(lower(x), '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')"


@_register("sentence_split", f"WITH s AS (SELECT doc_id, {_fill(_SENTENCES, c='text')} AS ss FROM documents) SELECT doc_id, CAST(unnest(range(len(ss))) AS INT) AS index, unnest(ss) AS sentence FROM s")
def _(documents):
    return documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("index", "sentence"))


@_register("sentence_hash", f"""WITH s AS (SELECT DISTINCT unnest({_fill(_SENTENCES, c='text')}) AS x FROM documents), n AS (SELECT x, hex(encode({_NORMAL})) AS h FROM s),
b AS (SELECT x, list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS HUGEINT)) AS bs FROM n)
SELECT x AS sentence, lower(format('{{:016x}}', CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, bs), lambda h, v: (xor(h, v) * 1099511628211) % 18446744073709551616) AS UBIGINT))) AS hash FROM b""")
def _(documents):
    return documents.select(F.explode(tx.sentences(F.col("text"))).alias("sentence")).distinct().select("sentence", tx.sentence_hash(F.col("sentence")).alias("hash"))


@_register("duplicate_report", f"""WITH s AS (SELECT doc_id, unnest({_fill(_SENTENCES, c='text')}) AS s FROM documents), c AS (SELECT doc_id, s, count(*) AS times FROM s GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, CAST(place AS INT) AS place, substr(s, 1, 60) AS sentence, times FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, s) AS place FROM c) WHERE place <= 3""")
def _(documents):
    return compress.repeated_sentences(documents)


_COMPRESSED = f"""s AS (SELECT {{id}} AS id, length(coalesce({{c}}, '')) AS n, {_fill(_SENTENCES, c='{c}')} AS ss FROM {{t}}),
u AS (SELECT id, n, ss, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS x FROM s), v AS (SELECT id, i, x, row_number() OVER (PARTITION BY id, {_NORMAL} ORDER BY i) AS r FROM u),
j AS (SELECT s.id, any_value(n) AS n, any_value(len(ss)) AS total, count(x) FILTER (WHERE r = 1) AS kept, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE r = 1), '') AS joined FROM s LEFT JOIN v ON v.id = s.id GROUP BY s.id),
f AS (SELECT *, CASE WHEN {{max}} > 0 AND length(joined) > {{max}} THEN CASE WHEN regexp_matches(substr(joined, 1, {{max}}), '[.?!。]') THEN regexp_extract(substr(joined, 1, {{max}}), '(?s)^(.*[.?!。])', 1) ELSE substr(joined, 1, {{max}}) END ELSE joined END AS final FROM j)
SELECT id AS {{as_}}, final AS text, n AS original_chars, length(final) AS compressed_chars, CASE WHEN n = 0 THEN 1.0 ELSE round(length(final) / n, 6) END AS ratio, CAST(total - kept AS BIGINT) AS sentences_removed, CAST(length(joined) - length(final) AS BIGINT) AS chars_saved_truncation FROM f"""


@_register("compress_text", "WITH " + _fill(_COMPRESSED, id="doc_id", as_="doc_id", c="text", t="documents", max=0))
def _(documents):
    return compress.compressed(documents)


@_register("sentence_dedup", f"""SELECT doc_id, sha256(text) AS text_sha256, sentences_removed FROM (WITH {_fill(_COMPRESSED, id='doc_id', as_='doc_id', c='text', t='documents', max=0)})""")
def _(documents):
    return compress.compressed(documents).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "sentences_removed")


@_register("compress_text_8000", "WITH " + _fill(_COMPRESSED, id="doc_id", as_="doc_id", c="text", t="documents", max=8000))
def _(documents):
    return compress.compressed(documents, 8000)


@_register("compress_chunks", _HITS + ", joined AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS t FROM hits GROUP BY query_id), " + _fill(_COMPRESSED, id="query_id", as_="query_id", c="t", t="joined", max=8000))
def _(embeddings, documents):
    hits = _hits(embeddings, documents)
    texts = hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("text"))
    return compress.compressed(texts, 4 * 2000, id_="query_id")


@_register("should_compress", "SELECT doc_id, length(text) // CASE WHEN regexp_matches(text, '[가-힣]') THEN 2 ELSE 4 END > 500 AS needed FROM documents")
def _(documents):
    return documents.select("doc_id", tx.should_compress(F.col("text"), 500).alias("needed"))


@_register("compress_with_similarity", None)
def _(documents, benchmark):
    """Of every document, the 15 sentences nearest to each question, in their order."""
    hashed = embed.hashing(64)
    return compress.compressed_for_queries(documents, _questions(benchmark).select("query_id", hashed(F.col("query")).alias("embedding")), hashed)


@_register("build_with_compression", _HITS + _PACKED + f", joined AS (SELECT query_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS t FROM packed GROUP BY query_id), {_fill(_COMPRESSED, id='query_id', as_='query_id', c='t', t='joined', max=3000)}".replace("SELECT id AS query_id, final AS text,", "SELECT id AS query_id, final AS text, CAST(ceil(length(final) / 4) AS BIGINT) AS tokens, round((1 - CASE WHEN n = 0 THEN 1.0 ELSE round(length(final) / n, 6) END) * 100, 4) AS saved_percent,").replace(", CAST(length(joined) - length(final) AS BIGINT) AS chars_saved_truncation", ""))
def _(embeddings, documents):
    return service.built_with_compression(_hits(embeddings, documents), 2000, 3000)


# chunks


_TITLES = ("제1조", "제1조 목적", "  제 12 조 정의", "제목 조", "제1", "Article 1", "", "제 3", "제9x", "제  4조", "x제1조", "제٣조")


@_register("chunk_article", r"WITH t AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TITLES) + rf"]) AS line UNION ALL SELECT '제' || doc_id || '조 ' || source FROM documents UNION ALL SELECT string_split(coalesce(text, ''), chr(10))[1] FROM documents) SELECT line AS line, list_transform([line], lambda x: regexp_matches({_TRIM}, '(?s)^제(\p{{N}}.| \p{{N}})'))[1] AS is_title FROM t")
def _(spark, documents):
    lines = spark.createDataFrame([(x,) for x in _TITLES], "line string")
    made = documents.select(F.concat(F.lit("제"), F.col("doc_id").cast("string"), F.lit("조 "), F.col("source")).alias("line"))
    first = documents.select(F.get(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.lit(0)).alias("line"))
    return lines.union(made).union(first).select("line", tx.article_title(F.col("line")).alias("is_title"))


@_register("chunk_paragraph", None)
def _(pages):
    """Chunks of the pages' source, by paragraphs first."""
    return chunk.chunked(pages, 500, "page_id", "html")


@_register("chunk_full", None)
def _(documents):
    return chunk.chunked(documents, 500)


@_register("chunk_overlap", None)
def _(documents):
    return chunk.chunked_with_overlap(documents, 1000, 50)


@_register("ingest_chunks", None)
def _(documents):
    """Chunks with hashed embeddings of the different texts."""
    return service.ingested(documents, 1000, embed.hashing(32))


# incremental

_SPLIT = "main AS (SELECT * FROM embeddings WHERE label % 2 = 0 OR label % 5 = 0), delta AS (SELECT * FROM embeddings WHERE label % 2 = 1)"


def _main_and_delta(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows.where("label % 2 = 0 OR label % 5 = 0").drop("label"), rows.where("label % 2 = 1").drop("label")


@_register("incremental_search", f"""WITH {_SPLIT}, every AS (SELECT 'main' AS source, * FROM main UNION ALL SELECT 'delta', * FROM delta),
d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, source, round(1 - round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6), 6) AS distance FROM embeddings q, every b WHERE q.vec_id % 50 = 0),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY distance, source) AS r FROM d) WHERE r = 1)
SELECT query_id, id, distance, source, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM one) WHERE rank <= 10""")
def _(embeddings):
    return incremental.search(_asked(embeddings), *_main_and_delta(embeddings), 10)


@_register("buffer_stats", f"WITH {_SPLIT} SELECT count(*) AS buffer_size, CAST(100 AS BIGINT) AS threshold, count(*) >= 100 AS needs_merge FROM delta")
def _(embeddings):
    return incremental.stats(_main_and_delta(embeddings)[1])


@_register("streaming_ingest", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def _(spark, embeddings, sf_dir):
    """The vectors arrive as a stream of files; what the index then has."""
    at = scratch.new_folder(spark, "delta")
    stream = spark.readStream.schema(embeddings.schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a file or a folder
    index = incremental.DeltaIndex(spark, f"{at}/index")
    index.follow(stream.select(F.col("vec_id").alias("id"), "embedding"), f"{at}/checkpoint").awaitTermination()
    return index.main().unionByName(index.delta()).select("id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"))


# quality


@_register("quality_recall_precision", "WITH " + _SIMS.format(where="q.vec_id % 50 = 0") + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims),
ql AS (SELECT vec_id AS query_id, label AS ql FROM embeddings WHERE vec_id % 50 = 0), n AS (SELECT query_id, count(*) AS n FROM ql JOIN embeddings ON label = ql GROUP BY query_id)
SELECT query_id, CAST(count(*) FILTER (WHERE rank <= 3 AND label = ql) AS BIGINT) AS hits, round(count(*) FILTER (WHERE rank <= 3 AND label = ql) / least(greatest(any_value(n), 1), 3), 6) AS recall,
 round(count(*) FILTER (WHERE rank <= 3 AND label = ql) / 3, 6) AS precision, count(*) FILTER (WHERE rank <= 3 AND label = ql) > 0 AS passed FROM r JOIN ql USING (query_id) JOIN n USING (query_id) GROUP BY query_id""")
def _(embeddings):
    hits = knn.top_k(_asked(embeddings), embeddings, 3).withColumnRenamed("vec_id", "doc_id")
    labels = embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return quality.judged(hits, labels.join(embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id"), 3)


# answers


@_register("bold_parts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\*\*(.+?)\*\*', 1)) AS BIGINT) AS n, array_to_string(regexp_extract_all(text, '\*\*(.+?)\*\*', 1), '|') AS parts FROM documents")
def _(documents):
    parts = tx.bold_parts(F.col("text"))
    return documents.select("doc_id", _long(F.size(parts)).alias("n"), F.array_join(parts, "|").alias("parts"))


@_register("response_unwrap", r"""WITH w AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'TextResponse("' || text || '")' WHEN 1 THEN 'TextResponse("' || text WHEN 2 THEN 'Said: TextResponse("' || text || chr(10) || '")' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, 'TextResponse("') AND ends_with(t, '")') THEN substr(t, strpos(t, 'TextResponse("') + 14, length(t) - strpos(t, 'TextResponse("') - 15) ELSE t END AS text FROM w""")
def _(conversations):
    """Wrapped whole, wrapped without an end, after other words and over two lines, and not wrapped."""
    start, text, kind = F.lit('TextResponse("'), F.col("text"), F.col("turn") % 4
    said = F.when(kind == 0, F.concat(start, text, F.lit('")'))).when(kind == 1, F.concat(start, text)).when(kind == 2, F.concat(F.lit("Said: "), start, text, F.lit('\n")'))).otherwise(text)
    return conversations.select("conv_id", "turn", tx.unwrapped_response(said).alias("text"))


try:
    import public_tokenizers
except ImportError:  # the vocabulary files aren't there
    public_tokenizers = None

if public_tokenizers:

    @_register("tokenize_round_trip", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
    def _(documents):
        """Texts to ids and back: a byte-level vocabulary gives every text again."""
        path = public_tokenizers.path("byte_bpe_50k.json")
        ids = embed.tokenize(path, 1 << 24)(F.col("text"))
        return documents.select("doc_id", F.sha2(embed.decode(path, 1 << 24)(ids), 256).alias("text_sha256"))
