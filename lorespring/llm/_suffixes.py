"""Suffix arrays by two-stage sorting, in numpy."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros past the end), most significant first."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a byte later. The empty suffix is the smallest."""
    n = len(data)
    if n == 0:
        return np.zeros(0, bool)
    differs = np.ones(n, bool)
    differs[:-1] = data[:-1] != data[1:]
    rises = np.zeros(n, bool)
    rises[:-1] = data[:-1] < data[1:]
    # a byte that equals its successor goes as that one does
    last = np.where(differs, np.arange(n), n)
    return rises[np.minimum.accumulate(last[::-1])[::-1]]


def direct_sort(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places `at` in the order of their suffixes' first `depth` bytes, at least."""
    if not len(at):
        return at
    words = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    tied = np.zeros(len(at) + 1, bool)
    tied[1:-1] = key[1:] == key[:-1]
    done = 8
    while done < depth:
        some = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(some):
            break
        # one number of the group of tied ones (above) and as many next bytes as there is room for
        group = np.cumsum(~tied[some])
        room = 8 - (int(group[-1]).bit_length() + 7) // 8
        key = words[at[some] + done] >> np.uint64(64 - 8 * room) | group.astype(np.uint64) << np.uint64(8 * room)
        order = np.argsort(key)
        at[some] = at[some][order]
        key = key[order]
        tied[some[1:]] &= key[1:] == key[:-1]
        done += room
    return at


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All places in the order of their suffixes' first `depth` bytes, at least.

    Suffixes smaller than their successor are sorted directly. The others are induced: the
    buckets (by first byte) are scanned from the smallest on, and each suffix that stands
    there puts the one that begins a byte earlier, if that is larger, at the front part of
    its own bucket. A bucket is scanned in one numpy step (one more for each repeat of its
    byte), in the order in which a sequential scan would meet its suffixes.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_than_next(data)
    direct = direct_sort(np.flatnonzero(small), words_at(data), depth)
    by_byte = np.searchsorted(data[direct], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    fronts[data[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first and puts the last one
    out = []
    for c in range(256):
        front = np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        parts = [front]
        while len(front):
            before = front[front > 0] - 1
            front = before[data[before] == c]
            parts.append(front)
        bucket = np.concatenate([*parts, direct[by_byte[c] : by_byte[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = data[before]
        later = first > c
        before, first = before[later], first[later]
        order = np.argsort(first, kind="stable")
        cuts = np.searchsorted(first[order], np.arange(257))
        for d in np.flatnonzero(np.diff(cuts)):
            fronts[d].append(before[order[cuts[d] : cuts[d + 1]]])
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """How many first bytes each place of `order` has in common with the one before it, up to `most`; 0 for the first. All places have `most` bytes left."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    open_ = np.arange(len(a))
    for k in range(0, most, 8):
        x = words[np.minimum(a[open_] + k, len(words) - 1)] ^ words[np.minimum(b[open_] + k, len(words) - 1)]
        same = np.zeros(len(x), np.int64)
        for j in range(8):  # zero bytes in front
            same += x < np.uint64(1 << (56 - 8 * j))
        out[open_ + 1] += same
        open_ = open_[same == 8]
        if not len(open_):
            break
    return np.minimum(out, most)
