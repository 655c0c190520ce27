"""Retrieval operators on small literals: edge cases, properties, plain-Python specifications."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespring.functions import text as tx
from lorespring.functions import vectors as vx
from lorespring.operators import bm25, chunk, compress, context, embed, hybrid, knn, quality
from lorespring.plans import service
from lorespring.sources import store
from lorespring.sources.store import SourceStore
from lorespring.streaming import incremental


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_sentences(spark):
    assert one(spark, tx.sentences, "안녕하세요. 반갑습니다! 어떻게 지내세요?") == ["안녕하세요.", "반갑습니다!", "어떻게 지내세요?"]
    assert one(spark, tx.sentences, "No end. rest") == ["No end.", "rest"]
    assert one(spark, tx.sentences, ". 。 a") == ["。", "a"]
    assert one(spark, tx.sentences, None) == []


def test_sentence_hash(spark):
    same = ["Hello World", "hello world", "  Hello   World  "]
    got = [one(spark, tx.sentence_hash, s) for s in [*same, "Goodbye World"]]
    assert got[0] == got[1] == got[2] == "779a65e7023cd2e7" != got[3]


def test_bm25_tokens(spark):
    assert one(spark, tx.bm25_tokens, "Hello, World! a é 가 x_1") == ["hello", "world", "é", "가", "x_1"]


def test_should_compress(spark):
    assert one(spark, lambda c: tx.should_compress(c, 100), "Hello") is False
    assert one(spark, lambda c: tx.should_compress(c, 10), "An English sentence of more than forty letters, surely.") is True


def test_utf16(spark):
    assert one(spark, tx.utf16_length, "a😀가") == 4


def test_repetition_and_answers(spark):
    stretch = "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(60))
    assert one(spark, tx.without_repetition, stretch + stretch + "".join(map(chr, range(0x4E00, 0x4E64)))) == stretch[:50] + "..."
    assert one(spark, tx.without_repetition, "short") == "short"
    assert one(spark, tx.unwrapped_response, 'TextResponse("a\nb")') == "a\nb"
    assert one(spark, tx.bold_parts, "a **b** c **d e**") == ["b", "d e"]


def test_bm25(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, "The lazy cat sleeps all day"), (3, "Quick brown cats are rare"), (4, ""), (5, None), (6, "a b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "lazy cat"), (1, "the the"), (2, "absent")], "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in bm25.search(docs, asked, 10).collect()}
    assert got[0, 1][0] == 2
    single = bm25.search(docs, spark.createDataFrame([(1, "the")], "query_id long, query string"), 10).collect()
    assert got[1, 1][1] == pytest.approx(2 * single[0].score, abs=2e-6)
    assert not any(q == 2 for q, _ in got)
    assert bm25.stats(docs).first().n == 3
    index = bm25.Index(spark, str(tmp_path / "index")).build(docs)
    assert len(index) == 3
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(index.search(asked, 10)) == key(bm25.search(docs, asked, 10))
    grown = bm25.Index(spark, str(tmp_path / "grown")).build(docs.where("doc_id < 3"))
    grown.add(docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("known already")).otherwise(F.col("text")))).add(docs)
    assert key(grown.search(asked, 10)) == key(bm25.search(docs, asked, 10))
    grown.remove(docs.where("doc_id = 2"))
    assert len(grown) == 2 and key(grown.search(asked, 10)) == key(bm25.search(docs.where("doc_id <> 2"), asked, 10))
    bm25.Index.FEW, few = 1, bm25.Index.FEW
    try:
        assert key(index.search(asked, 10)) == key(bm25.search(docs, asked, 10))
    finally:
        bm25.Index.FEW = few
    index.clear()
    assert not index.loaded()


def test_flat_store(spark, tmp_path):
    flat = store.FlatStore(spark, f"{tmp_path}/flat").init().init()
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("a", [3.0]), (None, [1.0])], "content string, embedding array<float>")
    got = {r.id: r.is_duplicate for r in flat.add_documents(rows).collect()}
    assert got == {1: False, 2: False} and flat.count() == 2
    assert [r.is_duplicate for r in flat.add_documents(rows.where("content = 'b'")).collect()] == [True]
    with pytest.raises(ValueError):
        flat.add_documents(spark.createDataFrame([("c", [])], "content string, embedding array<float>"))
    flat.add_simple(rows.where("content = 'b'"))
    assert flat.count() == 3
    moved = flat.migrate(f"{tmp_path}/moved")
    assert moved.count() == 2 and moved.read().where("content_hash IS NULL").count() == 0
    hits = spark.createDataFrame([(1, 0.5), (77, 0.4), (99, 0.3)], "doc_id long, score double")
    chunks = spark.createDataFrame([(77, "of a chunk")], "chunk_id long, content string")
    assert {r.doc_id for r in hybrid.content_of(hits, moved.read().select(F.col("id").alias("doc_id"), "content"), chunks).collect()} == {1, 77}
    moved.drop()


#: Four kinds of things, six sentences each, and what is asked of them: words of a sentence that answers.
KINDS = {
    "fruit": ["crisp red apples", "sweet yellow bananas from the tropics", "juicy oranges full of vitamins", "dark grapes that become wine", "huge green melons", "ripe red berries"],
    "animal": ["loyal dogs kept as a pet", "quiet cats kept as a pet", "long-eared rabbits kept as a pet", "clever wild monkeys", "heavy wild elephants", "cold wild penguins"],
    "company": ["cars that run on batteries", "phones with a bitten logo", "search engines for the web", "phones that fold", "windows for office desks", "parcels for every shop"],
    "dish": ["spicy korean cabbage", "italian bread baked with cheese", "japanese rice with raw fish", "american beef in a bun", "italian noodle plates", "asian noodle soup"],
}
ASKED = [("fruit", None), ("red fruit", "red"), ("pet animal", "pet"), ("wild animal", "wild"), ("company", None), ("phones company", "phones"), ("italian dish", "italian"), ("noodle dish", "noodle"), ("dish", None), ("yellow fruit", "yellow")]


def test_quality_set(spark):
    """Recall and precision of the three best over a small set whose answers are known."""
    docs = [(k * 10 + i, f"This {kind} is about {text}", kind, text) for k, (kind, texts) in enumerate(KINDS.items()) for i, text in enumerate(texts)]
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    vectors = table.select("doc_id", embed.hashing(256)(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(ASKED)], "query_id long, query string").withColumn("embedding", embed.hashing(256)(F.col("query")))
    relevant = [(n, i) for n, (q, word) in enumerate(ASKED) for i, _, kind, text in docs if kind == q.split()[-1] and (word is None or word in text.split())]
    hits = hybrid.search(table, vectors, asked, 3)
    whole = quality.summary(quality.judged(hits, spark.createDataFrame(relevant, "query_id long, doc_id long"), 3)).first()
    assert whole.pass_rate == 1.0 and whole.recall >= 0.93 and whole.precision >= 0.6


def test_cosine_in_batches(spark):
    rows = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], []), ([3.0, 4.0], [3.0, 4.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vx.cosine_in_batches(a, b), F.coalesce(vx.cosine(a, b), F.lit(0.0))).collect()
    assert all(x == pytest.approx(y) for x, y in got) and got[0][0] == pytest.approx(0.8)


def test_knn_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, None), (6, [float("nan"), 1.0]), (7, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.vec_id, r.similarity) for r in knn.top_k(asked, vectors, 9).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 1.0), (2, 0.0), (7, -1.0)]
    assert knn.top_k(asked, vectors.limit(0), 3).count() == 0


def test_ivf_recall(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    data = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in knn.top_k(asked, vectors, 10).collect()}
    index = knn.IvfIndex(spark, f"file://{tmp_path}/ivf")
    assert not index.loaded()
    near = {(r.query_id, r.vec_id) for r in index.build(vectors).search(asked, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    again = knn.IvfIndex(spark, f"file://{tmp_path}/ivf")  # what was built is there for others
    assert again.loaded() and len(again) == 1500
    assert {(r.query_id, r.vec_id) for r in again.search(asked, 10, probes=100).collect()} == exact
    again.clear()
    assert not index.loaded()


def test_ivf_edges(spark, tmp_path):
    kind = "vec_id long, embedding array<float>"
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, None), (3, [1.0])], "query_id long, embedding array<float>")
    index = knn.IvfIndex(spark, f"file://{tmp_path}/none").build(spark.createDataFrame([], kind))
    assert index.search(asked, 3).count() == 0 and len(index) == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (None, [1.0, 0.0]), (6, [0.0, 0.0])], kind)
    index = knn.IvfIndex(spark, f"file://{tmp_path}/two").build(mixed)
    assert len(index) == 4
    assert [(r.query_id, r.vec_id) for r in index.search(asked, 1, probes=9).orderBy("query_id").collect()] == [(0, 1), (1, 3)]
    hot = spark.createDataFrame([(i, [1.0, i / 1e6]) for i in range(3000)], kind)  # one cell has them all
    index = knn.IvfIndex(spark, f"file://{tmp_path}/hot").build(hot, cells=1)
    assert index.search(asked.where("query_id = 0"), 5).count() == 5


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(0, 3, 1), (0, 4, 2)], "query_id long, doc_id long, rank int")
    x = {r.doc_id: r.score for r in hybrid.fused(a, b, 9).collect()}
    y = {r.doc_id: r.score for r in hybrid.fused(b, a, 9).collect()}
    assert x == y and max(x, key=x.get) == 3
    assert x[1] == pytest.approx(0.5 / 61, abs=1e-9)
    empty = a.limit(0)
    assert {r.doc_id: r.bm25_rank for r in hybrid.fused(a, empty, 9).collect()} == {1: 0, 2: 0, 3: 0}


def hits(spark, rows):
    return spark.createDataFrame([(0, s, i, c, v, n + 1) for n, (s, i, c, v) in enumerate(rows)], "query_id long, source_id long, chunk_index int, content string, similarity double, rank long")


def greedy(sources):
    left, out, last = list(sources), [], None
    while left:
        at = next((i for i, (s, _) in enumerate(left) if s != last), 0)
        out.append(left.pop(at))
        last = out[-1][0]
    return out


def test_diverse(spark):
    names = [(1, 1), (1, 2), (1, 3), (2, 4), (3, 5)]
    got = context.diverse(hits(spark, [(s, i, "x", 0.5) for s, i in names])).orderBy("rank").collect()
    assert [(r.source_id, r.chunk_index) for r in got] == [(1, 1), (2, 4), (1, 2), (3, 5), (1, 3)]
    rng = random.Random(4)
    names = [(rng.randint(1, 4), i) for i in range(30)]
    got = context.diverse(hits(spark, [(s, i, "x", 0.5) for s, i in names])).orderBy("rank").collect()
    assert [(r.source_id, r.chunk_index) for r in got] == greedy(names)


def test_packing_stops_at_the_first_overflow(spark):
    rng = random.Random(5)
    for budget in (0, 1, 10, 57, 300):
        sizes = [rng.randint(0, 200) for _ in range(12)]
        total, expected = 0, 0
        for i, n in enumerate(sizes):
            cost = math.ceil(n / 4) + (2 if i else 0)
            if total + cost > budget:
                break
            total, expected = total + cost, i + 1
        got = context.packed(hits(spark, [(1, i, "x" * n, 0.1) for i, n in enumerate(sizes)]), budget)
        assert got.count() == expected


def test_prompt(spark):
    asked = spark.createDataFrame([(0, "why?"), (1, "how?")], "query_id long, query string")
    text = context.context(hits(spark, [(7, 1, "b", 0.5), (7, 0, "a", 0.4), (8, 0, "c", 0.3)]))
    got = {r.query_id: r.prompt for r in context.prompt(asked, text).collect()}
    assert got[1] == "how?"
    assert "=== Document 7 ===\n\na\n\nb" + context.BETWEEN + "=== Document 8 ===\n\nc" in got[0]
    said = context.messages(asked, text, spark.createDataFrame([(0, t, "user", f"m{t}") for t in range(14)], "query_id long, turn long, role string, text string"))
    assert {r.query_id: len(r.messages) for r in said.collect()} == {0: 12, 1: 2}


def test_single_source(spark):
    rows = [(1, 0, "apple pie", 0.5), (2, 0, "banana", 0.9), (1, 1, "apple tree", 0.3)]
    asked = spark.createDataFrame([(0, "An apple")], "query_id long, query string")
    assert {r.source_id for r in context.best_source_by_text(hits(spark, rows), asked).collect()} == {1}
    assert {r.source_id for r in context.best_source_by_score(hits(spark, rows)).collect()} == {2}
    none = spark.createDataFrame([(0, "zzz")], "query_id long, query string")
    assert {r.source_id for r in context.best_source_by_text(hits(spark, rows), none).collect()} == {2}
    low = [(1, 0, "a", -1.0), (2, 0, "b", -1.0)]
    assert context.best_source_by_score(hits(spark, low)).count() == 2


def test_compress(spark):
    docs = spark.createDataFrame([(1, "첫 번째 문장입니다. 두 번째 문장입니다. 첫 번째 문장입니다."), (2, ""), (3, None), (4, "One. Two! Three"), (5, "끝。다음。")], "doc_id long, text string")
    got = {r.doc_id: r for r in compress.compressed(docs).collect()}
    assert got[1].sentences_removed == 1 and got[1].ratio < 1
    assert got[2].ratio == got[3].ratio == 1.0
    short = {r.doc_id: r.text for r in compress.compressed(docs, 6).collect()}
    assert short[4] == "One." and short[5] == "끝。 다음。"
    assert {r.doc_id: r.text for r in compress.compressed(docs, 2).collect()}[5] == "끝。"


def test_compress_by_similarity(spark):
    e = embed.hashing(32)
    texts = spark.createDataFrame([(0, "The cat sleeps. Stock prices rose. A cat and a dog.")], "query_id long, text string")
    asked = spark.createDataFrame([(0, "cat sleeps")], "query_id long, query string").select("query_id", e(F.col("query")).alias("embedding"))
    assert compress.compressed_by_similarity(texts, asked, e, least=0.3).first().text.startswith("The cat sleeps.")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .?\n제1조é가", max_size=400), st.integers(50, 160))
def test_chunks_keep_all_letters(text, most):
    got = chunk.chunks_of(text, most)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(c for c, _, _ in got)) == squeeze(text)
    assert all(b - a == len(c.encode()) for c, a, b in got)


def test_chunk_cases():
    assert chunk.chunks_of("", 100) == chunk.chunks_of(None, 100) == []
    assert [c for c, _, _ in chunk.chunks_of("one\n\ntwo", 100)] == ["one", "two"]
    lines = "\n".join(["a" * 60, "b" * 30, "c" * 60])
    assert [c for c, _, _ in chunk.chunks_of(lines, 100)] == ["a" * 60 + "\n" + "b" * 30, "c" * 60]
    assert [len(c) for c, _, _ in chunk.chunks_of("x" * 250, 100)] == [100, 100, 50]
    assert chunk.articles("머리\n제1조 목적\n내용\n제2조 정의") == ["머리", "제1조 목적\n내용", "제2조 정의"]


def test_incremental(spark):
    vec = lambda s: [float(math.sin(s + i)) for i in range(384)]
    kind = "id long, embedding array<float>"
    delta = spark.createDataFrame([(i, vec(i)) for i in (1, 2, 3)], kind)
    asked = spark.createDataFrame([(0, vec(1))], "query_id long, embedding array<float>")
    first = incremental.search(asked, delta, delta, 3).where("rank = 1").first()
    assert (first.id, first.source) == (1, "delta")


def test_delta_index_stream(spark, tmp_path):
    index = incremental.DeltaIndex(spark, f"file://{tmp_path}/index")
    source = str(tmp_path / "in")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(130)]
    spark.createDataFrame(rows[:60], incremental.ROWS).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(incremental.ROWS).parquet(source)
    index.follow(stream(), str(tmp_path / "cp")).awaitTermination()
    assert (index.delta().count(), index.main().count()) == (60, 0)
    spark.createDataFrame(rows[60:], incremental.ROWS).coalesce(1).write.mode("append").parquet(source)
    index.follow(stream(), str(tmp_path / "cp")).awaitTermination()
    assert (index.delta().count(), index.main().count()) == (0, 130)
    index.add(spark.createDataFrame([(0, [9.0, 9.0, 9.0])], incremental.ROWS), "extra")
    index.remove(spark.createDataFrame([(5,)], "id long"), "one")
    assert (index.delta().count(), index.main().count()) == (1, 129)


def test_store(spark, tmp_path):
    store = SourceStore(spark, str(tmp_path / "store")).init()
    new = spark.createDataFrame([("a", None), ("b", "m"), ("a", None)], "content string, metadata string")
    first = {r.content_hash: (r.source_id, r.is_duplicate) for r in store.add_sources(new).collect()}
    assert sorted(v[0] for v in first.values()) == [1, 2] and not any(v[1] for v in first.values())
    again = store.add_sources(spark.createDataFrame([("a",), ("c",)], "content string")).collect()
    assert sorted((r.source_id, r.is_duplicate) for r in again)[-1] == (3, False) and sum(r.is_duplicate for r in again) == 1
    chunks = spark.createDataFrame([(s, i, f"c{i}", 0, 2, None) for s in (1, 2) for i in range(5)], "source_id long, chunk_index int, content string, start_pos int, end_pos int, embedding array<float>")
    assert store.add_chunks(chunks) == 10
    assert [r.content for r in store.source_chunks(1).collect()] == ["c0", "c1", "c2", "c3", "c4"]
    assert [r.chunk_index for r in store.adjacent_chunks(1, 1, 3).collect()] == [1, 2, 3]
    store.delete(spark.createDataFrame([(1,)], "source_id long"))
    assert tuple(store.stats().first()) == (2, 5)
    assert tuple(store.compact(str(tmp_path / "other")).stats().first()) == (2, 5)
    store.clear()
    assert tuple(store.stats().first()) == (0, 0)


def test_service(spark):
    e = embed.hashing(64)
    docs = spark.createDataFrame([(1, "Apple makes phones.\n\nApple sells music."), (2, "Rivers flow to the sea."), (3, "Rivers flow to the sea.")], "doc_id long, text string")
    chunks = service.ingested(docs, 100, e).withColumn("chunk_id", F.col("source_id") * 100 + F.col("chunk_index"))
    assert chunks.count() == 3
    asked = spark.createDataFrame([(0, "apple phones")], "query_id long, query string").withColumn("embedding", e(F.col("query")))
    found, contexts = service.search(chunks, asked, service.DESKTOP[2])
    assert {r.source_id for r in found.collect()} == {1}
    assert "Apple makes phones." in contexts.first().text


def test_quality(spark):
    found = spark.createDataFrame([(0, 1, 1), (0, 9, 2)], "query_id long, doc_id long, rank int")
    relevant = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4), (1, 5)], "query_id long, doc_id long")
    got = {r.query_id: tuple(r)[1:] for r in quality.judged(found, relevant, 3).collect()}
    assert got == {0: (1, 0.333333, 0.333333, True), 1: (0, 0.0, 0.0, False)}
    assert quality.summary(quality.judged(found, relevant, 3)).first().pass_rate == 0.5


def test_pooling_and_tokens(spark):
    assert embed.mean_pooled(np.arange(12.0).reshape(1, 3, 4), 3).tolist() == [4.0, 5.0, 6.0, 7.0]
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("hello world",)], "x string").withColumn("ids", embed.tokenize(path)(F.col("x")))
    assert df.select(embed.decode(path)(F.col("ids"))).first()[0] == "hello world"
    assert embed.vocabulary_size(path) == 50257


def test_tokenizer_gets_a_bounded_part_of_a_batch(monkeypatch):
    """A batch of long texts doesn't go to the tokenizer at once (it did), and comes back as it was."""
    sizes = []

    class Words:
        def encode_batch_fast(self, texts):
            sizes.append(sum(map(len, texts)))
            return [type("Encoding", (), {"ids": [ord(c) for c in t]}) for t in texts]

        def decode_batch(self, ids, skip_special_tokens):
            sizes.append(sum(map(len, ids)))
            return ["".join(map(chr, i)) for i in ids]

    monkeypatch.setattr(embed, "_tokenizer", lambda path, most: Words())
    texts = ["a" * 3000, None, "", "b" * 5 * embed.AT_ONCE, *["c" * 1000] * 500]
    ids = embed.ids_of(texts, "", 1)
    assert embed.texts_of(ids, "", 1) == [t or "" for t in texts]
    assert sorted(sizes)[-2:] == [5 * embed.AT_ONCE] * 2 and sorted(sizes)[-3] <= embed.AT_ONCE  # a text is never cut
    assert [len(i) for i in embed.ids_of([], "", 1)] == []


def test_bm25_index_is_written_a_part_at_a_time(spark, tmp_path, monkeypatch):
    """Postings aren't shuffled, and a task inverts FLUSH tokens at a time (it sorted its part of all postings)."""
    rows = [(i, f"common w{i % 7} w{i % 3} common" if i % 5 else None) for i in range(60)] + [(1, "common x1 y1 z1"), (70, "a")]  # an id and length twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "common w1"), (1, "w2 w2 x1")], "query_id long, query string")
    key = lambda df: sorted(map(tuple, df.collect()))
    for flush in (1, 10, bm25.Index.FLUSH):
        monkeypatch.setattr(bm25.Index, "FLUSH", flush)
        index = bm25.Index(spark, str(tmp_path / f"index{flush}")).build(docs.coalesce(1))
        lists = index._lists().where("term = 'common'")
        assert lists.count() >= 49 * 4 // (flush + 8) + 1 and lists.selectExpr("max(size(ids))").first()[0] <= max(flush // 4 + 1, 1)
        assert key(index.search(asked, 10)) == key(bm25.search(docs, asked, 10))
        monkeypatch.setattr(bm25.Index, "PAIRS", 1)
        assert key(index.search(asked, 10)) == key(bm25.search(docs, asked, 10))
        monkeypatch.undo()
    plan = index.search(asked, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_few_hits_go_to_the_texts(spark):
    """Where hits are few, they are sent to the documents; whole texts were shuffled to them."""
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, content string")
    hits = spark.createDataFrame([(0, 1), (0, 2), (0, 9), (1, 3), (1, 1)], "query_id long, doc_id long")
    got = hybrid.content_of(hits, docs, few=True)
    assert sorted((r.query_id, r.doc_id, r.content) for r in got.collect()) == [(0, 1, "a"), (1, 1, "a"), (1, 3, "c")]
    assert sorted((r.query_id, r.doc_id, r.content) for r in hybrid.content_of(hits, docs).collect()) == [(0, 1, "a"), (1, 1, "a"), (1, 3, "c")]
    vectors = docs.select("doc_id", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    asked = spark.createDataFrame([(0, "cc", [1.0, 1.0])], "query_id long, query string, embedding array<float>")
    found = hybrid.search(docs.select("doc_id", F.col("content").alias("text")), vectors, asked, 2)
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()


def test_knn_does_not_move_vectors(spark, tmp_path, monkeypatch):
    """Queries go to the vectors: no join, in which all vectors had one key and blocks of them stood in one task. Too many queries to send meet spread blocks, with the same result."""
    rng = np.random.default_rng(1)
    data = rng.integers(-2, 3, (700, 4)).astype(float)  # many ties, and zero vectors
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, [float("nan")] * 4), (901, None), (902, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "similarity", "rank").collect()))
    index = knn.IvfIndex(spark, f"file://{tmp_path}/ivf").build(vectors)
    every, near, least = knn.top_k(asked, vectors, 9), index.search(asked, 9, probes=2), knn.top_k(asked, vectors, 9, least=0.9)
    whole = index.search(asked, 9, probes=index.MOST_CELLS)
    for df in (every, near, whole, least):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    norms = np.sqrt((data * data).sum(1))
    both = norms[:, None] * norms[None]
    sim = np.round(np.divide(data @ data.T, both, out=np.zeros_like(both), where=both > 0), 6) + 0.0
    expected = []
    for q in range(0, 700, 3):
        order = np.lexsort((np.arange(700), -sim[q]))[:9]
        expected += [(q, int(v), float(sim[q, v]), r + 1) for r, v in enumerate(order)]
    got = key(every)
    assert [g for g in got if g[0] < 900] == sorted(expected) and key(whole) == got
    sent = key(near), key(least)
    assert sent[1] == [g for g in got if g[2] >= 0.9]
    monkeypatch.setattr(knn._Nearest, "HELD", 50)
    seen = knn._Nearest(np.arange(0, 700, 3), data[::3], 9, None)
    for a in range(0, 700, 5):
        seen.see(np.arange(a, a + 5), data[a : a + 5])
    parts = [b.to_pydict() for b in seen.found(["q", "v", "s"])]
    assert sorted((q, v, s) for p in parts for q, v, s in zip(p["q"], p["v"], p["s"])) == sorted(e[:3] for e in expected)
    monkeypatch.setattr(knn, "SENT", 0)
    assert key(knn.top_k(asked, vectors, 9)) == got and key(index.search(asked, 9, probes=index.MOST_CELLS)) == got
    assert (key(index.search(asked, 9, probes=2)), key(knn.top_k(asked, vectors, 9, least=0.9))) == sent


def test_sentences_are_held_against_all_queries_at_once(spark, monkeypatch):
    """Vectors meet the queries in the batch in which they are made (they were paired one by one by a join), with the same result."""
    hashed = embed.hashing(8)
    docs = spark.createDataFrame([(i, f"Cats sleep {i}. Dogs bark {i % 3}! Cats sleep {i}. Nothing here. A fish? a {i}") for i in range(30)] + [(90, None), (91, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(3, "cats sleep"), (5, "a fish"), (8, "dogs 1 bark"), (9, "")], "query_id int, query string").select("query_id", hashed(F.col("query")).alias("embedding"))
    key = lambda df: sorted(map(tuple, df.collect()))
    df = compress.compressed_for_queries(docs, asked, hashed, top=2)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and df.schema["query_id"].dataType.simpleString() == "int"
    got = key(df)
    monkeypatch.setattr(compress.knn, "SENT", 0)
    assert len(got) > 30 and key(compress.compressed_for_queries(docs, asked, hashed, top=2)) == got
