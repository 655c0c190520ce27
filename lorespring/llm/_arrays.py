"""Vectorised text primitives over Arrow batches.

Every function works on whole texts. A null text counts as an empty one.

The hash of a span of bytes is a polynomial in a seeded base modulo the prime 2**61 - 1,
scrambled: two different spans of up to n bytes share one with a chance of about n / 2**61
over the base, whatever the spans are (modulo a power of two, as cheaper hashes are, some
strings collide for every base). Shingles add up the scrambled hashes of their words, times
seeded odd factors modulo 2**64.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as numpy arrays at a time (a longer text is one chunk by itself).
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64((1 << 61) - 1)
_BASE = int(_rng.integers(1 << 40, (1 << 61) - 2))
_INVERSE = pow(_BASE, -1, (1 << 61) - 1)
_31, _30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: A table of powers of up to so many is kept: what the operators hash at a time.
_KEPT = 5 * CHUNK_BYTES
#: Bytes of a span whose terms are summed without a carry: 2**9 (a byte, plus 1) * 2**31 * 2**24 = 2**64.
_PIECE = 1 << 24


def _reduced(t: np.ndarray) -> np.ndarray:
    """t modulo 2**61 - 1."""
    t = (t & _P) + (t >> np.uint64(61))
    return np.where(t >= _P, t - _P, t)


def _times(a: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """a * (high * 2**31 + low) modulo 2**61 - 1; a < 2**61, high < 2**30, low < 2**31."""
    ah, al = a >> np.uint64(31), a & _31
    middle = ah * low + al * high
    # 2**62 is 2, and middle * 2**31 is its upper part and 2**31 times its lower 30 bits
    return _reduced(np.uint64(2) * ah * high + (middle >> np.uint64(30)) + ((middle & _30) << np.uint64(31)) + al * low)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) modulo 2**61 - 1, as their upper 30 and lower 31 bits. Tables of up to _KEPT are kept; a longer one is for one use."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        all_ = np.ones(1, np.uint64)
        size = max(-(-n // CHUNK_BYTES), 2) * CHUNK_BYTES
        while len(all_) < size:
            step = pow(base, len(all_), (1 << 61) - 1)
            all_ = np.concatenate([all_, _times(all_[: size - len(all_)], np.uint64(step >> 31), np.uint64(step) & _31)])
        have = ((all_ >> np.uint64(31)).astype(np.uint32), (all_ & _31).astype(np.uint32))
        if size <= _KEPT:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null gives no bytes."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def chunks(lengths: list[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows whose lengths add up to about the limit."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small record batches with the bytes of their texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = texts_of(batch.column(batch.schema.get_field_index(column)))
        for part in chunks([len(t) for t in texts], limit):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


@dataclass
class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of some texts: where each begins and ends in data, the text it is of, its hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


class Buffer:
    """Some texts in one array, each followed by a space."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        self.data = np.frombuffer(b" ".join(itertools.chain(texts, [b""])), np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        lengths = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.starts = np.zeros(self.n + 1, np.int64)
        np.cumsum(lengths + 1, out=self.starts[1:])
        self._sums: tuple[np.ndarray, np.ndarray] | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each data[start:end], whatever stands around it."""
        if self._sums is None:
            terms = self.data.astype(np.uint64) + np.uint64(1)
            self._sums = tuple(np.zeros(len(terms) + 1, np.uint64) for _ in range(2))
            for sums, power in zip(self._sums, _power(_BASE, len(terms))):
                np.cumsum(terms * power, out=sums[1:])
        lengths = ends - starts
        h = self._sum(starts, np.minimum(ends, starts + _PIECE))
        for k in np.flatnonzero(lengths > _PIECE):
            for at in range(int(starts[k]) + _PIECE, int(ends[k]), _PIECE):
                part = np.array([at])
                h[k : k + 1] = _reduced(h[k : k + 1] + self._sum(part, np.minimum(part + _PIECE, ends[k])))
        back = _power(_INVERSE, len(self.data) + 1)
        h = _times(h, back[0][starts].astype(np.uint64), back[1][starts].astype(np.uint64))
        return mix(h ^ (lengths.astype(np.uint64) * _MIX[60]))

    def _sum(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The terms from each start to each end, up to _PIECE of them, modulo 2**61 - 1."""
        high, low = (x[ends] - x[starts] for x in self._sums)  # what wrapped around in the sums comes back here
        high = _reduced(high)
        return _reduced((high >> np.uint64(30)) + ((high & _30) << np.uint64(31)) + _reduced(low))

    def words(self) -> Words:
        solid = ~_SPACE[self.data]
        before = np.zeros_like(solid)
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & ~before)
        ends = np.flatnonzero(before & ~solid)  # every text ends in a space
        doc = np.searchsorted(self.starts, starts, "right") - 1
        return Words(self.data, starts, ends, doc, self.hashes(starts, ends), np.bincount(doc, minlength=self.n))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of `width` words within a text: the index of its first word, its text and hash."""
    n = len(words.starts)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h += words.hashes[at + j] * _MIX[j]
    return at, words.doc[at], mix(h)


def shingle_sets(texts: list[bytes], width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, as (offsets, hashes sorted within a text).

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    buffer = Buffer(texts, lower)
    words = buffer.words()
    _, doc, h = shingles(words, width)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        first = np.zeros(buffer.n + 1, np.int64)
        np.cumsum(words.counts, out=first[1:])
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = words.counts[short] > j
            whole[has] += words.hashes[first[short[has]] + j] * _MIX[j + 20]
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, mix(whole ^ (words.counts[short].astype(np.uint64) * _MIX[40]))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    offsets = np.zeros(buffer.n + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=buffer.n), out=offsets[1:])
    return offsets, h
