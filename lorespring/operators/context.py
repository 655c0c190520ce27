"""From hits to a prompt: narrowing, expanding, ordering, packing and rendering.

Hits are rows of (query_id, source_id, chunk_index, content, similarity, rank); every
operator works on all queries at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import estimated_tokens, utf16_length

SEPARATOR = "\n\n---\n\n"
_RULE = "=" * 10
BETWEEN = f"\n\n{_RULE} DIFFERENT DOCUMENT {_RULE}\n\n"
STRICT = "Use nothing but the documents below to answer, and say so where they hold no answer."
LENIENT = "Use the documents below to answer."


def expanded(hits: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Hits with their neighbours up to n places away in the same source. A hit wins over a neighbour, whose similarity is 0; ordered by source and place (rank is new)."""
    keys = ["query_id", "source_id"]
    band = hits.select(*keys, F.col("chunk_index").alias("at"), "similarity").join(chunks.select("source_id", "chunk_index", "content"), "source_id").where(F.col("chunk_index").between(F.greatest(F.col("at") - n, F.lit(0)), F.col("at") + n))
    own = F.col("chunk_index") == F.col("at")
    merged = band.groupBy(*keys, "chunk_index").agg(F.first("content").alias("content"), F.coalesce(F.max(F.when(own, F.col("similarity"))), F.lit(0.0)).alias("similarity"))
    return chronological(merged)


def _winner(hits: DataFrame, points: Column) -> DataFrame:
    """query_id and its winning source: the one with most points or, in queries where none has a point, the one with the largest sum of similarities over -1. Ties go to the source that comes first."""
    sums = hits.groupBy("query_id", "source_id").agg(F.sum(points).alias("points"), F.round(F.sum("similarity"), 6).alias("total"), F.min("rank").alias("seen"))
    most = F.max("points").over(W.Window.partitionBy("query_id"))
    sums = sums.withColumn("score", F.when(most > 0, F.col("points")).when(F.col("total") > -1, F.col("total"))).where("score IS NOT NULL")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return sums.withColumn("place", F.row_number().over(order)).where("place = 1").select("query_id", F.col("source_id").alias("winner"))


def _narrowed(hits: DataFrame, winners: DataFrame) -> DataFrame:
    """Hits of the winning source; all of a query without one."""
    joined = hits.join(winners, "query_id", "left").where(F.col("winner").isNull() | (F.col("winner") == F.col("source_id"))).drop("winner")
    return joined


def best_source_by_score(hits: DataFrame) -> DataFrame:
    return _narrowed(hits, _winner(hits, F.lit(0)))


def best_source_by_text(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Each hit scores a point for every query word of more than two letters that it contains and 100 for the whole query; the source with most points wins. Where nothing scores, similarity decides."""
    words = F.filter(F.split(F.lower("query"), r"[\s()]+"), lambda w: utf16_length(w) > 2)
    asked = hits.join(queries.select("query_id", F.lower("query").alias("whole"), words.alias("words")), "query_id")
    text = F.lower("content")
    points = F.size(F.filter("words", lambda w: F.contains(text, w))) + F.when(F.contains(text, F.col("whole")), 100).otherwise(0)
    return _narrowed(hits, _winner(asked, points))


def chronological(hits: DataFrame) -> DataFrame:
    """Ordered by source and place."""
    return hits.withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy("source_id", "chunk_index")))


def diverse(hits: DataFrame) -> DataFrame:
    """Greedily reordered: always the earliest hit left whose source isn't the last one's; when one source is left, the rest as it is. A fold over a query's hits, which are a top-k list."""
    packed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_id", "chunk_index", "content", "similarity"))).alias("left"))
    item = packed.schema["left"].dataType.elementType.simpleString()
    start = F.expr(f"named_struct('done', cast(array() as array<{item}>), 'left', left)")

    def step(state: Column, _: Column) -> Column:
        done, left = state["done"], state["left"]
        last = F.get(done, F.size(done) - 1)["source_id"]
        others = F.filter(left, lambda x: last.isNull() | (x["source_id"] != last))
        chosen = F.coalesce(F.get(others, F.lit(0)), F.get(left, F.lit(0)))
        return F.struct(F.concat(done, F.array(chosen)).alias("done"), F.filter(left, lambda x: x["rank"] != chosen["rank"]).alias("left"))

    ordered = packed.select("query_id", F.aggregate("left", start, step)["done"].alias("done"))
    return ordered.select("query_id", F.posexplode("done").alias("place", "x")).select("query_id", "x.source_id", "x.chunk_index", "x.content", "x.similarity", (F.col("place") + 1).alias("rank"))


def packed(hits: DataFrame, budget: int, separator: str = SEPARATOR) -> DataFrame:
    """The first hits whose estimated tokens, with a separator's for all but the first, stay within the budget; `tokens` is the running sum."""
    order = W.Window.partitionBy("query_id").orderBy("rank")
    own = estimated_tokens(utf16_length(F.col("content")))
    gap = -(-len(separator.encode("utf-16-le")) // 2 // 4)
    step = own + F.when(F.row_number().over(order) > 1, gap).otherwise(0)
    return hits.withColumn("step", step).withColumn("tokens", F.sum("step").over(order.rowsBetween(W.Window.unboundedPreceding, 0))).where(F.col("tokens") <= budget).drop("step")


def grouped_text(hits: DataFrame, headers: bool = True) -> DataFrame:
    """(query_id, text, tokens, n_chunks): sources in the order of their first hit, chunks of a source by place."""
    tokens = F.max("tokens") if "tokens" in hits.columns else F.lit(0)
    by_source = hits.groupBy("query_id", "source_id").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"), tokens.alias("tokens"), F.count("*").alias("n"))
    body = F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n")
    head = F.concat(F.lit("=== Document "), F.col("source_id").cast("string"), F.lit(" ===\n\n")) if headers else F.lit("")
    texts = by_source.select("query_id", "first", "tokens", "n", F.concat(head, body).alias("text"))
    return texts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), BETWEEN).alias("text"), F.max("tokens").alias("tokens"), F.sum("n").alias("n_chunks"))


def context(hits: DataFrame, budget: int = 2000, strategy: str = "relevance", single_source: bool = False, separator: str = SEPARATOR) -> DataFrame:
    """Hits -> grouped text within the budget, with remaining_budget. Queries without hits have no row."""
    rows = best_source_by_score(hits) if single_source else hits
    rows = {"relevance": lambda x: x, "diverse": diverse, "chronological": chronological}[strategy](rows)
    return grouped_text(packed(rows, budget, separator)).withColumn("remaining_budget", budget - F.col("tokens"))


def prompt(queries: DataFrame, contexts: DataFrame, strict: bool = True, instruction: str | None = None) -> DataFrame:
    """(query_id, prompt): the query alone where there is no context."""
    said = instruction or (STRICT if strict else LENIENT)
    joined = queries.select("query_id", "query").join(contexts.select("query_id", "text"), "query_id", "left")
    full = F.concat(F.lit(said + "\n\n--- Documents ---\n"), F.col("text"), F.lit("\n--- End of documents ---\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer:"))
    return joined.select("query_id", F.when(F.coalesce("text", F.lit("")) == "", F.col("query")).otherwise(full).alias("prompt"))


def messages(queries: DataFrame, contexts: DataFrame, history: DataFrame | None = None, last: int = 10) -> DataFrame:
    """(query_id, messages): system, up to `last` messages of the history (query_id, turn, role, text) and the user's."""
    joined = queries.select("query_id", "query").join(contexts.select("query_id", "text"), "query_id", "left")
    system = F.when(F.coalesce("text", F.lit("")) == "", F.lit("Answer helpfully.")).otherwise(F.concat(F.lit(STRICT + "\n\n"), F.col("text")))
    joined = joined.withColumn("system", F.struct(F.lit("system").alias("role"), system.alias("content"))).withColumn("user", F.struct(F.lit("user").alias("role"), F.col("query").alias("content")))
    if history is None:
        return joined.select("query_id", F.array("system", "user").alias("messages"))
    recent = last_messages(history, last, "query_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    past = F.transform(F.coalesce("h", F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return joined.join(recent, "query_id", "left").select("query_id", F.concat(F.array("system"), past, F.array("user")).alias("messages"))


def last_messages(history: DataFrame, last: int = 10, by: str = "conv_id") -> DataFrame:
    """The last messages of each conversation."""
    order = W.Window.partitionBy(by).orderBy(F.desc("turn"))
    return history.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= last).drop("__r")


def mock_answer(hits: DataFrame, shown: int = 3, preview: int = 100) -> DataFrame:
    """(query_id, answer): previews of the first hits, numbered."""
    short = F.when(F.length("content") > preview, F.concat(F.substring("content", 1, preview), F.lit("..."))).otherwise(F.col("content"))
    lines = hits.where(F.col("rank") <= shown).select("query_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), short).alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("answer"))
