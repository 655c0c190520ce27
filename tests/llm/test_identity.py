"""Rows that share ids, texts, keys or hashes: no text is lost, none counts for another, and no task gets all of them."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespring.llm import _arrays, langid, license_scan, mixing, parity_join, quality, sharding, stream_dedup, suffix_dedup, unit_dedup
from lorespring.llm._suffixes import direct_sort, words_at

KIND = "doc_id long, text string, lang string, source string, n_chars long"
A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
C = "red orange yellow green blue indigo violet black white grey brown pink teal navy olive"


def twins():
    """Repeated ids with different texts, null ids, equal rows, one text under many ids and spacings, the smallest long."""
    rows = [(1, A), (3, A), (3, B), (None, A), (None, A), (None, B), (2, B), (7, "a b"), (7, "ab"), (8, C), (8, C), (8, C), (-(2**63), C + " end"), (9, None), (None, None), (9, ""), (5, "  " + C), (None, "only one")]
    return [(i, t, "en", s, len(t or "")) for (i, t), s in zip(rows, itertools.cycle(["a", "b", None]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(twins(), KIND).repartition(3)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def test_each_text_stays_once(docs):
    kept = stream_dedup.unique(docs)
    assert kept.columns == docs.columns
    groups = collections.defaultdict(list)
    for i, t, *_ in twins():
        groups[normal(t)].append((-len(t or ""), i is None, i or 0))
    expected = sorted((k, *min(g)[1:]) for k, g in groups.items())
    assert sorted((normal(r.text), r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == expected
    rows = stream_dedup.op7(docs).collect()
    assert len(rows) == len(twins()) and sum(r.kept for r in rows) == len(groups)
    assert {r.text_sha256: r.group_size for r in rows} == {hashlib.sha256(k.encode()).hexdigest(): len(g) for k, g in groups.items()}


def test_each_component_stays_once(docs):
    kept = parity_join.representatives(docs)
    assert kept.columns == docs.columns
    texts = collections.Counter(r.text for r in kept.collect())
    # C, C + end and the spaced C are one component, the smallest long leads it; empty texts link with nothing
    assert texts == collections.Counter([A, B, "a b", "ab", C + " end", None, None, "", "only one"])
    found = collections.Counter((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in parity_join.op2(docs).collect())
    assert found[3, 12, 3, 1] == 1 and found[3, 14, 2, 2] == 1 and found[None, 12, 3, 1] == 2 and found[None, 1, 0, None] == 1
    assert found[8, 11, 4, -(2**63)] == 3


def test_the_mix_is_what_was_taken(docs, monkeypatch):
    # equal rows may swap what is taken of each, so words are counted by id and text
    plan = collections.Counter()
    for r in mixing.op4(docs).collect():
        plan[r.doc_id] += r.taken
    words = collections.Counter()
    for r in mixing.mixed(docs).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == +plan
    monkeypatch.setattr(mixing, "HOT_ROWS", 2)
    assert sum(len(r.text.split()) for r in mixing.mixed(docs).collect()) == sum(r.taken for r in mixing.op4(docs).collect())


def test_many_sources_and_shards(spark, docs, monkeypatch):
    """What the driver finds for few sources and shards is what aggregations find for many."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice([*"abcdefgh", None]), 1) for i in range(150)]
    many = spark.createDataFrame(rows, KIND)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    few = key(mixing.op4(many))
    monkeypatch.setattr(mixing, "LOCAL_ROWS", 2)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    assert key(mixing.op4(many)) == few


def test_state_outlives_a_run(spark, tmp_path):
    state = str(tmp_path / "state")
    first = [(1, "x y"), (2, "z"), (3, "xy")]
    second = [(4, "x  y "), (5, "new"), (6, "z")]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs{n}")
    one = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in stream_dedup.dedup(spark.read.parquet(f"{tmp_path}/docs0"), state).collect()}
    assert one == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}
    two = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in stream_dedup.dedup(spark.read.parquet(f"{tmp_path}/docs1"), state).collect()}
    assert two == {4: (4, 3, True), 5: (5, 1, True), 6: (2, 2, False)}  # 4 is the longest so far
    # the state names where a text stands, and the bytes there are what is compared
    out = spark.read.parquet(f"{state}/out/batch=*")
    assert out.where("stays.path IS NULL OR stays.row IS NULL").count() == 0
    spark.createDataFrame([(6, "another text")] * 3, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/docs0")
    with pytest.raises(Exception):  # the text that the state points to has gone
        stream_dedup.dedup(spark.createDataFrame([(9, "z")], "doc_id long, text string"), state).collect()


def thue_morse(n):
    x = b"a"
    while len(x) < n:
        x += bytes(195 - c for c in x)
    return x.decode()


def test_hashes_of_thue_morse_strings(spark):
    pairs = [(thue_morse(n), thue_morse(n).translate({97: 98, 98: 97})) for n in (256, 1024, 2048, 4096, 8192)]
    for x, y in pairs:
        h = _arrays.Buffer([x.encode(), y.encode()]).words().hashes
        assert h[0] != h[1]
        base, _ = quality.statistics([f"{x}\n{y}\n".encode()])
        assert base["n_dup_lines"][0] == 0
    rows = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    assert rows.count() == sum(1 for r in parity_join.op2(rows).collect() if r.n_similar == 0)
    assert {r.n_removed for r in unit_dedup.op6(rows).collect()} == {0}


def test_equal_hashes_are_told_apart_by_bytes():
    data = np.frombuffer(b"abcabcabdxyz", np.uint8)
    begins, lengths = np.array([0, 3, 6, 9]), np.full(4, 3)
    number = suffix_dedup.exact(np.zeros(4, np.uint64), data, begins, lengths)
    assert number[0] == number[1] and len(set(number.tolist())) == 3


def test_a_hash_is_of_its_span_wherever_it_stands():
    rng = random.Random(1)
    text = rng.randbytes(3000).replace(b" ", b"x")
    alone = _arrays.Buffer([text]).hashes(np.array([0]), np.array([len(text)]))
    whole = _arrays.Buffer([b"ab", text, b"zz"])
    assert whole.hashes(np.array([3]), np.array([3 + len(text)])) == alone
    old, _arrays._PIECE = _arrays._PIECE, 64
    try:
        assert _arrays.Buffer([text]).hashes(np.array([0]), np.array([len(text)])) == alone
    finally:
        _arrays._PIECE = old


def test_powers_are_kept_for_all_that_a_task_hashes_at_a_time():
    n = 4 * suffix_dedup.TEXT_BYTES + 2
    first = _arrays._power(_arrays._BASE, n)
    assert len(first[0]) == n and all(np.shares_memory(a, b) for a, b in zip(first, _arrays._power(_arrays._BASE, n)))
    p, k = (1 << 61) - 1, n - 1
    assert (int(first[0][k]) << 31) + int(first[1][k]) == pow(_arrays._BASE, k, p)


def test_workers_of_passages_keep_what_they_freed(spark, monkeypatch):
    environment = spark.sparkContext.environment
    before, seen = dict(environment), []
    whole = suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda *a: (seen.append(environment.get("MALLOC_TRIM_THRESHOLD_")), whole(*a))[1])
    suffix_dedup.passages(spark.createDataFrame([(1, A)], "doc_id long, text string"))
    assert seen and set(seen) == {str(32 << 20)} and environment == before


def test_runs_are_of_windows_with_one_least_hash():
    rng = random.Random(3)
    texts = [b"", b"x" * 49, b"y" * 50, b"z" * 900, b"ab" * 300, *(bytes(rng.choices(b"abcde ", k=n)) for n in (51, 52, 400, 3000, 7, 1000))]
    text, first, size, anchor = (x.tolist() for x in suffix_dedup.runs(texts))
    found = [(t, f + k, a) for t, f, n, a in zip(text, first, size, anchor) for k in range(n)]
    expected = []
    for t, raw in enumerate(texts):
        for p in range(len(raw) - suffix_dedup.LENGTH + 1):
            expected.append((t, p, int(suffix_dedup.anchors_at(np.frombuffer(raw[p : p + suffix_dedup.LENGTH], np.uint8)).min())))
    assert found == expected and max(size) <= 255


def test_direct_sort_goes_by_bytes():
    rng = np.random.default_rng(7)
    data = np.concatenate([np.tile(rng.integers(97, 99, 300), 3), rng.integers(97, 100, 2000)]).astype(np.uint8)
    raw, at = data.tobytes(), rng.permutation(len(data) - 64)
    order = direct_sort(at, words_at(data), 50)
    assert sorted(order.tolist()) == list(range(len(data) - 64))
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in at)


def test_one_string_in_many_different_texts(spark):
    """An anchor that stands in every document among different words is sent by windows, with the same result."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    boiler = "All rights reserved, do not copy this."
    rows = [(i, f"{word()} {word()} {boiler} {word()} {word()}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " " + word()) for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda d: sorted(tuple(r) for r in d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    plain, hot = key(suffix_dedup.passages(df)), key(suffix_dedup.passages(df, hot_runs=5))
    assert plain == hot and sum(r[2] for r in hot) > 300


def test_a_thousand_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(1000):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    for r in parity_join.op2(df).collect():
        assert r.component_id == 0
        if r.doc_id % 100 == 0:
            mine = sets[r.doc_id]
            assert r.n_similar == sum(100 * len(mine & s) >= 80 * len(mine | s) for s in sets) - 1
    assert parity_join.representatives(df).count() == 1


def test_pairs_across_size_bands():
    """Of sets at the bounds of the bands, near the threshold, each shares as many keys as it is said to need with its only partner."""
    rng = np.random.default_rng(8)
    for n in (128, 129, 158, 160, 161, 200, 201, 250, 251):
        m = n * 5 // 4
        for _ in range(20):
            big = np.sort(rng.integers(0, 2**63, m, dtype=np.uint64))
            small = np.sort(rng.choice(big, n, replace=False))
            of, role, need, key_role, key = parity_join.keys_of(np.array([0, n, n + m]), np.concatenate([small, big]))
            by = {}
            for r in range(len(of)):
                by.setdefault((int(of[r]), int(role[r])), (int(need[r]), set(key[key_role == r].tolist())))
            both = {r for s, r in by if s == 0} & {r for s, r in by if s == 1}
            assert both
            for s in (0, 1):
                assert any(len(by[0, r][1] & by[1, r][1]) >= by[s, r][0] for r in both)


def test_hot_keys_are_spread(spark):
    rows = [(7 if i % 3 == 0 else i, "x" * 100) for i in range(3000)]
    placed = sharding.external_shuffle(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "octet_length(text)", shards=10, bucket_bytes=20_000).collect()
    counts, hot = collections.Counter(r.shard for r in placed), collections.Counter(r.shard for r in placed if r.doc_id == 7)
    assert set(counts.values()) == {300} and len({(r.shard, r.slot) for r in placed}) == 3000
    assert sorted(r.doc_id for r in placed) == sorted(i for i, _ in rows)
    assert len(hot) == 10 and max(hot.values()) < 160


def test_reruns_place_hot_keys_alike(spark):
    """Also with equal records among them, whatever files and partitions they come in."""
    rows = [(7, f"{i % 90}" * 50) if i % 3 == 0 else (i, "x" * 100) for i in range(900)]
    place = lambda d: collections.Counter((r.doc_id, r.text, r.shard, r.slot) for r in sharding.external_shuffle(d, "doc_id", "octet_length(text)", shards=10, bucket_bytes=5000).collect())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = place(df)
    assert found == place(df.repartition(3)) and len({k[2:] for k in found}) == 900
    assert collections.Counter(k[:2] for k in found.elements()) == collections.Counter(rows)


# brute force that shares no code with the operators


def test_language_by_counting(spark):
    """Naive Bayes over hashed n-grams with a dictionary for each language."""
    rng = random.Random(11)
    letters = {"xx": "abeiklmo", "yy": "prstuvwz", "zz": "aeiouxyz"}
    make = lambda l: " ".join("".join(rng.choices(letters[l], k=rng.randint(2, 7))) for _ in range(rng.randint(1, 9))) + rng.choice(["", "!", " 42", "É"])
    rows = [(i, make(l), l) for i in range(150) for l in [rng.choice(list(letters))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        flat = [32, 32, *(ord(c.lower()) if c.isalpha() else 32 for c in text), 32]
        for n in (1, 2, 3):
            for i in range(len(flat) - n + 1):
                part = flat[i : i + n]
                if any(c != 32 for c in part):
                    h = n * 374761393 & 0xFFFFFFFF
                    for c, f in zip(part, (2654435761, 2246822519, 3266489917)):
                        h = ((h ^ (c * f & 0xFFFFFFFF)) * 2246822519) & 0xFFFFFFFF
                        h ^= h >> 15
                    yield (h * 2654435761 & 0xFFFFFFFF) >> 17

    import math
    import zlib

    counts = {l: collections.Counter() for l in letters}
    for i, t, l in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[l].update(grams(t))
    total = {l: sum(c.values()) for l, c in counts.items()}
    got = {r.doc_id: r for r in langid.op1(df).collect()}
    for i, t, _ in rows:
        like = {l: sum(math.log((c[g] + 0.5) / (total[l] + 0.5 * 32768)) for g in grams(t)) for l, c in counts.items()}
        top = max(like.values())
        share = 1 / sum(math.exp(v - top) for v in like.values())
        assert got[i].score == pytest.approx(share, abs=1e-3)
        if share > 0.51:
            assert like[got[i].lang_pred] == top
    model = langid.fit(df, buckets=64)
    assert model.weights.shape == (65, 3)


def test_more_languages_hash_to_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX", 3 * 4096)
    df = spark.createDataFrame([(i, "abc def " * 3 if i % 3 else "xyz uvw " * 3, "ab"[i % 2] if i % 3 else "c") for i in range(40)] + [(None, "abc", "zz"), (None, None, None)], "doc_id long, text string, lang string")
    assert langid.fit(df).weights.shape == (4097, 3)
    rows = langid.op1(df).collect()
    assert all(r.held_out is not None for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)


def test_verdicts_by_walking_the_trees(spark):
    """`kept` is what the trees' nodes say, walked one by one, over statistics counted one by one."""
    rng = random.Random(13)
    good = lambda: " ".join(rng.choice(["river", "stone", "window", "carries", "morning", "slowly"]) + rng.choice(["", "."]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["#$%", "BUY", "x1", "99", "<a>"]) + str(rng.randint(0, 999)) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(0, 300) if i % 5], "doc_id long, quality int"))
    names = list(quality.FEATURES)

    def features(t):
        w = t.split()
        letters = "".join(w)
        return {"log_words": np.log1p(len(w)), "word_length": len(letters) / len(w), "symbols_per_word": sum(c in "#*$%&|<>" for c in t) / len(w), "dup_lines_per_line": 0.0, "words_per_line": len(w), "distinct_words": len(set(w)) / len(w), "upper_share": sum("A" <= c <= "Z" for c in t) / len(letters), "digit_share": sum("0" <= c <= "9" for c in t) / len(letters), "stop_share": sum(len(x) <= 3 for x in w) / len(w), "short_lines": 0.0, "letter_share": sum(c.isascii() and c.isalpha() for c in t) / len(letters)}

    wrong = 0
    for r in quality.judge(docs, forest).collect():
        x = features(rows[r.doc_id][1])
        x["repeat_share"] = r.n_repeat_words / r.n_words
        total = forest.start
        for k in forest.roots.tolist():
            while forest.left[k] != k:
                k = int(forest.left[k] if x[names[forest.feature[k]]] <= forest.threshold[k] else forest.right[k])
            total += forest.value[k]
        p = 1 / (1 + np.exp(-total))
        assert r.quality_score == pytest.approx(p, abs=1e-9)
        assert r.kept == (not r.base_failed and p >= quality.ACCEPT)
        if r.doc_id % 5 == 0:  # not fitted on
            wrong += (p >= 0.5) != bool(r.doc_id % 2)
    assert wrong <= 3


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def test_licenses_by_sets_of_words(spark):
    """Containment of word triples, and the same when every window is sketched."""
    rng = random.Random(17)
    names = sorted(license_scan.TEMPLATES)
    triples = lambda t: {tuple(w[i : i + 3]) for w in [words_of(t)] for i in range(len(w) - 2)}
    sets = {n: triples(t) for n, t in license_scan.TEMPLATES.items()}
    filler = [f"f{k}" for k in range(500)]
    texts = []
    for k, n in enumerate(names):
        body = license_scan.TEMPLATES[n].split()
        if k % 2:  # a word in thirty is another
            body = [w if i % 30 else "other" for i, w in enumerate(body)]
        texts.append((k, " ".join([*rng.choices(filler, k=rng.randint(0, 300)), *body, *rng.choices(filler, k=50)])))
    texts += [(1000 + k, " ".join(rng.choices(filler, k=400))) for k in range(5)] + [(2000, None), (2001, "two words")]
    found = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in license_scan.op9(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    index = license_scan.Index()
    for k, t in texts:
        mine = triples(t or "")
        whole = {n for n, s in sets.items() if len(s & mine) >= license_scan.CONTAINED * len(s)}
        # what only adds up over the whole text, and in no window, isn't a copy
        assert found[k] <= whole and (k >= len(names) or names[k] not in whole or names[k] in found[k]), k
        assert k < len(names) or not whole
        h = license_scan.shingle_lists([(t or "").encode()])[1]
        if len(h) < 3000:
            assert {index.names[j] for j in index.find(h, every=True)} == found[k]


def test_copies_are_no_work_for_suffix_arrays(spark):
    """Of equal texts one document goes on to the anchors (all did), and what is removed stays the same."""
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randrange(999)) for _ in range(n))
    whole, other, short = words(40), words(30), "short"
    rows = [(i, whole) for i in range(40, 0, -1)] + [(1, whole), (0, other), (50, whole[:120] + other), (None, "x" + other), (7, short), (8, short), (9, None), (9, words(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends").collect()), key=str)

    def expected(i, text):
        mine, text = -(1 << 63) if i is None else i, (text or "").encode()
        gone = [False] * len(text)
        for p in range(len(text) - 49):
            if any((-(1 << 63) if d is None else d) < mine and text[p : p + 50] in (t or "").encode() for d, t in rows):
                gone[p : p + 50] = [True] * 50
        edges = [p for p in range(len(text) + 1) if (p > 0 and gone[p - 1]) != (p < len(text) and gone[p])]
        kept = bytes(b for b, g in zip(text, gone) if not g)
        return i, len(text), sum(gone), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2], edges[1::2]

    assert got == sorted((expected(*r) for r in rows), key=str)
    read = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("owner", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)))
    left = suffix_dedup._unrepeated(read, suffix_dedup._firsts(read))
    assert left.count() == 8 and left.where("length(text) > 300 AND doc_id BETWEEN 1 AND 40").count() == 2  # doc 1, twice
