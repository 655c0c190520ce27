"""Best-fit packing of token sequences, after a dominance reduction by Martello and Toth.

Documents become tokens in one pass that gives a narrow row per piece (never the ids).
A piece's length is between 1 and the capacity, so an instance of any size is a
histogram of `capacity` counts: that is all the driver sees. There the reduction fixes,
for the longest open length, a set that dominates every other set that it could be put
with (alone if nothing fits; with a partner that fills up exactly; with the longest
partner that fits, if no two pieces fit, or if no two that fit are longer together and
no three fit). What no set dominates is packed best-fit: the partner that leaves the least
room, again and again. Sets of equal lengths are fixed as many at a time as the counts
allow, so the work depends on the number of different lengths, not of documents. The
plan (patterns, with the first sequence and how many) goes back to the pieces, which
find their place by their rank among the pieces of their length; ranks come from counts
per (length, slice of a seeded hash), so no length is ever gathered into one task.

Cases: a null text is empty and gives its end token alone; documents longer than the
capacity are cut, the remainder first; repeated rows are documents of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._spark import written

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: About so many pieces of one length get their ranks in one task.
SLICE_ROWS, MOST_SLICES = 1 << 16, 1 << 14


@functools.cache
def encoder(vocabulary: str):
    """texts -> lists of ids, as tokenizers gives them without added special tokens (a special token's own string in a text is its id). A byte-level BPE of which a rank file is there too is run by tiktoken, which gives the same ids several times faster; others by tokenizers."""
    import public_tokenizers

    if vocabulary == "byte_bpe_50k.json":
        import tiktoken

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [fast.encode(t, allowed_special="all") if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; a remainder comes first."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if first and s == 0 else capacity) for s in starts]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), run([t or "" for t in part.column(1).to_pylist()])):
                    raw = np.array([*ids, end], "<u4").tobytes()
                    for i, (s, n) in enumerate(cut(len(ids) + 1, capacity)):
                        for column, value in zip(out, (doc_id, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Open:
    """Lengths that still have pieces, by count."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()

    def upto(self, room: int, without: tuple[int, ...] = ()) -> int:
        """The longest open length of at most `room`, when one piece of each of `without` is taken; 0 if there is none."""
        for s in np.flatnonzero(self.counts[1 : room + 1])[::-1] + 1 if room > 0 else ():
            if self.counts[s] > without.count(int(s)):
                return int(s)
        return 0

    def smallest(self, n: int, without: tuple[int, ...]) -> list[int]:
        """The n shortest pieces left."""
        out: list[int] = []
        for s in np.flatnonzero(self.counts):
            out += [int(s)] * min(n - len(out), int(self.counts[s]) - without.count(int(s)))
            if len(out) == n:
                break
        return out


def _pair_in(counts: np.ndarray, low: int, high: int, without: tuple[int, ...]) -> bool:
    """Whether two pieces are together longer than low and at most high."""
    left = counts.copy()
    for s in without:
        left[s] -= 1
    have = left > 0
    sums = np.flatnonzero(have)
    for a in sums:
        if 2 * a > high:
            break
        span = have[max(a, low - a + 1) : high - a + 1].copy()
        if len(span) and low - a + 1 <= a and left[a] < 2:
            span[0] = False
        if span.any():
            return True
    return False


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns (lengths, how many sequences are so) that hold all pieces, and how many sequences the reduction fixed. counts[s]: pieces of length s."""
    open_, out, fixed = _Open(counts), [], 0
    while (longest := open_.upto(capacity)) > 0:
        room, pattern, dominates = capacity - longest, (longest,), False
        partner = open_.upto(room, pattern)
        if partner == 0:
            dominates = True
        elif partner == room:
            pattern, dominates = (longest, partner), True
        else:
            small = open_.smallest(3, pattern)
            if len(small) < 2 or sum(small[:2]) > room:
                pattern, dominates = (longest, partner), True
            elif (len(small) < 3 or sum(small) > room) and not _pair_in(open_.counts, partner, room, pattern):
                pattern, dominates = (longest, partner), True
        if not dominates:  # best fit: fill with the piece that leaves the least room
            while (partner := open_.upto(capacity - sum(pattern), pattern)) > 0:
                pattern += (partner,)
        need = {s: pattern.count(s) for s in pattern}
        times = min(int(open_.counts[s]) // n for s, n in need.items())  # what dominates goes on to while pieces only get fewer
        for s, n in need.items():
            open_.counts[s] -= n * times
        fixed += times * dominates
        out.append((pattern, times))
    return out, fixed


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """For each length and run of ranks: (length, first rank, first sequence, offset), sorted. A piece of rank r in such a run is in sequence first + (r - first rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for s in pattern:
            rows.append((s, used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(found: DataFrame, capacity: int = CAPACITY, seed: int = 5) -> DataFrame:
    """found (rows of pieces()) with sequence_id and offset."""
    spark = found.sparkSession
    found = written(found, "pieces")
    table = found.groupBy("length").count().toArrow()  # `capacity` rows at most
    counts = np.zeros(capacity + 1, np.int64)
    counts[table.column("length").to_numpy()] = table.column("count").to_numpy()
    runs = spark.sparkContext.broadcast(places(plan(counts, capacity)[0]))
    slices = int(min(MOST_SLICES, max(1, -(-int(counts.max()) // SLICE_ROWS))))
    sliced = found.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), F.lit(slices)).cast("int"))
    by_slice = sliced.groupBy("length", "__slice").count()
    before = F.sum("count").over(W.Window.partitionBy("length").orderBy("__slice")) - F.col("count")
    # capacity x MOST_SLICES rows at most, each slice of SLICE_ROWS pieces or more but where a length is rare
    starts = by_slice.select("length", "__slice", before.alias("__before"))
    ranked = sliced.withColumn("__rank", F.row_number().over(W.Window.partitionBy("length", "__slice").orderBy("doc_id", "piece", "ids_crc32"))).join(starts, ["length", "__slice"])
    rank = F.col("__before") + F.col("__rank") - 1

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, sequences, offsets = runs.value.T
        keys = lengths * (1 << 44) + firsts
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * (1 << 44) + at, "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequences[k] + at - firsts[k]), pa.array(offsets[k])], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", rank.cast("long").alias("rank")).mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
