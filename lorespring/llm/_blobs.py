"""Many small records in one piece of binary: arrays as byte planes, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ROWS = "bucket int, kind int, blob binary"


def pack(*arrays: tuple[np.ndarray, int]) -> bytes:
    """Arrays of non-negative integers, of each as many low bytes as are given, in planes (all lowest bytes first), so that what hardly changes takes no room."""
    head = np.array([len(arrays), *(x for a, size in arrays for x in (len(a), size))], np.int64).tobytes()
    planes = [a.astype(np.uint8).tobytes() if size == 1 else np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes() for a, size in arrays]
    raw = b"".join([head, *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack(), as uint8, uint32 or uint64, whichever holds them."""
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for length, size in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        kind = np.dtype(np.uint8 if size == 1 else np.uint32 if size <= 4 else np.uint64)
        wide = np.zeros((length, kind.itemsize), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length).T
        out.append(wide.reshape(-1).view(kind))
        at += length * size
    return out


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit hashes, by their upper bits; within one they differ in the lower 40."""
    return ((value >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def slices(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    if not len(sorted_):
        return []
    cuts = (np.flatnonzero(np.diff(sorted_)) + 1).tolist()
    return [(int(sorted_[a]), a, b) for a, b in zip([0, *cuts], [*cuts, len(sorted_)])]


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def joined(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """The arrays of several blobs of pack(), end to end."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(width)]


def blobs_of(group: pa.Table, kind: int) -> list[bytes]:
    return [b for k, b in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist()) if k == kind]


def had_by_two(value: np.ndarray, who: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by value: whether two different ones (who) have the value, or one entry is sure of that; and which entries are the first of their value."""
    start = np.ones(len(value), bool)
    if not len(value):
        return start, start
    start[1:] = value[1:] != value[:-1]
    run = np.cumsum(start) - 1
    low = np.minimum.reduceat(who, np.flatnonzero(start))
    return np.bincount(run, (who != low[run]) | sure)[run] > 0, start
