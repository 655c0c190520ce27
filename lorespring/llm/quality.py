"""Quality rules: gradient-boosted trees over document statistics.

One pass over the texts gives each document's statistics. The trees are grown here, on a
bounded sample of labelled documents: histogram splits, logistic loss, and monotonic
constraints (a split that would let the score fall where it must not is not made, and the
values of its children are bound by the middle between them). They are flattened into
numpy node arrays, which score a batch level by level without a Python loop over rows.

Cases: null and empty texts have zero statistics and fail the base rule (fewer than 10
words); unlabelled rows are scored like others; labels that are null or neither 0 nor 1
don't teach; without labels of both kinds the trees' verdict is to keep. Texts are read
whole. Repeated rows are judged alike. An empty table gives no rows. Other columns of the
documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import Buffer, shingles, text_chunks

#: Fit on about this many labelled documents at most, chosen by a hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 4, 0.15, 48, 30, 2.0
#: A document that passes the base rule is dropped if its probability of being good is under this.
ACCEPT = 0.35
#: Each feature and how the score may move with it: 1 only up, -1 only down, 0 freely.
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines_per_line": -1, "repeat_share": -1, "words_per_line": 0, "distinct_words": 0, "upper_share": -1, "digit_share": 0, "stop_share": 0, "short_lines": 0, "letter_share": 0}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _masked_sums(mask: np.ndarray, buffer: Buffer) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[buffer.starts[1:]] - sums[buffer.starts[:-1]]


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contract's counts of each text, and the features (texts x FEATURES)."""
    buffer = Buffer(texts)
    words = buffer.words()
    n, data, n_words = buffer.n, buffer.data, words.counts
    point = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    lengths = points[words.ends] - points[words.starts]
    word_chars = np.bincount(words.doc, lengths, n).astype(np.int64)
    symbols = _masked_sums(_SYMBOL[data], buffer)

    # lines: what lies between newlines and the ends of the texts
    breaks = np.flatnonzero(data == 10)
    tails = buffer.starts[1:] - 1
    line_ends = np.sort(np.concatenate([breaks, tails]))
    line_doc = np.searchsorted(buffer.starts, line_ends, "right") - 1
    line_starts = np.empty_like(line_ends)
    if len(line_ends):
        line_starts[0] = 0
        line_starts[1:] = line_ends[:-1] + 1
    word_line = np.searchsorted(line_ends, words.starts)
    in_line = np.bincount(word_line, minlength=len(line_ends))
    solid = np.flatnonzero(in_line)
    line_hash, solid_doc = buffer.hashes(line_starts[solid], line_ends[solid]), line_doc[solid]
    n_lines = np.bincount(solid_doc, minlength=n)
    dup_lines = n_lines - _distinct(solid_doc, line_hash, n)
    short_lines = np.bincount(solid_doc[in_line[solid] < 4], minlength=n)

    at, doc, h = shingles(words, 5)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    if len(at):
        order = np.lexsort((h, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 5, -1)
    repeat = np.bincount(words.doc[np.cumsum(covered)[:-1] > 0], minlength=n)

    base = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}
    some, lines = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    upper = _masked_sums((data >= 65) & (data <= 90), buffer)
    digits = _masked_sums((data >= 48) & (data <= 57), buffer)
    letters = _masked_sums(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC0), buffer)
    chars = np.maximum(word_chars, 1)
    stop = np.bincount(words.doc[lengths <= 3], minlength=n)
    features = np.stack([np.log1p(n_words), word_chars / some, symbols / some, dup_lines / lines, repeat / some, n_words / lines, _distinct(words.doc, words.hashes, n) / some, upper / chars, digits / chars, stop / some, short_lines / lines, letters / chars], axis=1)
    return {k: v.astype(np.int64) for k, v in base.items()}, features


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n)


@dataclass
class Forest:
    """Trees as node arrays: node k of a tree sends rows with feature[k] <= threshold[k] to left[k], else to right[k]; a leaf is its own child and adds value[k]."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each row of x."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotonic: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boosted trees for labels y (0 or 1)."""
    columns: list[list] = [[], [], [], [], []]
    feature, threshold, left, right, value = columns
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin, roots = np.full(len(y), start), []

    def leaf(v: float) -> int:
        k = len(feature)
        for column, item in zip(columns, (0, np.inf, k, k, v)):
            column.append(item)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def weight(gs, hs, low: float, high: float):
            return np.clip(-gs / (hs + RIDGE), low, high)

        def gain(gs, hs, w):
            return -(gs * w + 0.5 * (hs + RIDGE) * w * w)

        def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            own = float(weight(gs, hs, low, high))
            best = (1e-6, 0, 0, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * LEAST_ROWS:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    wl, wr = weight(gl, hl, low, high), weight(gs - gl, hs - hl, low, high)
                    more = gain(gl, hl, wl) + gain(gs - gl, hs - hl, wr) - gain(gs, hs, own)
                    bad = (nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS) | (monotonic[j] * (wr - wl) < 0)
                    more[bad] = -np.inf
                    k = int(more.argmax())
                    if more[k] > best[0]:
                        best = (float(more[k]), j, k, float(wl[k]), float(wr[k]))
            if best[0] <= 1e-6:
                margin[rows] += rate * own
                return leaf(rate * own)
            _, j, k, wl, wr = best
            goes = binned[rows, j] <= k
            middle = (wl + wr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotonic[j]]
            node = leaf(0.0)
            a = build(rows[goes], level + 1, *bounds[0])
            b = build(rows[~goes], level + 1, *bounds[1])
            feature[node], threshold[node], left[node], right[node] = j, cuts[j][k], a, b
            return node

        roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf))
    arrays = (np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float))
    return Forest(start, np.array(roots, np.int64), *arrays, depth)


def always() -> Forest:
    """The verdict where there is nothing to learn from."""
    none = np.zeros(0)
    return Forest(20.0, none.astype(np.int64), none.astype(np.int64), none, none.astype(np.int64), none.astype(np.int64), none, 0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Trees grown on at most about `rows` labelled documents."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = usable.count()
    part = min(1.0, rows / max(n, 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < int(part * (1 << 20)))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            _, x = statistics(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(c) for c in x.T)], names=["doc_id", "quality", *names])

    # bounded by `rows`
    table = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(measure, "doc_id long, quality int, " + ", ".join(f"{x} double" for x in names)).toArrow().sort_by([("doc_id", "ascending"), *((x, "ascending") for x in names)])
    y = table.column("quality").to_numpy().astype(float)
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return always()
    return grow(np.stack([table.column(x).to_numpy() for x in names], axis=1), y, list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest, accept: float = ACCEPT) -> DataFrame:
    """Statistics and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text"):
            base, x = statistics(texts)
            p = shared.value.score(x)
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[k]) for k in names), pa.array(failed), pa.array(~failed & (p >= accept)), pa.array(p)], names=["doc_id", *names, "base_failed", "kept", "quality_score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, quality_score double")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
