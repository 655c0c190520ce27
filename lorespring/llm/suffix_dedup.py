"""Suffix-array dedup of passages that repeat across documents.

Every byte is removed that a LENGTH-byte string covers which also starts in a document
with a smaller doc_id. Strings are judged on the input.

A suffix array of the whole corpus fits into no task. It is cut by content instead: each
LENGTH-byte window has an anchor, the least hash of its ANCHOR-byte strings. Equal windows
have equal anchors, and neighbouring windows mostly share theirs, so a text has one run of
windows for about every dozen bytes.

0. Of equal texts only the smallest document goes on; the others lose all, as each of their
   strings starts in it, too.
1. Each task packs the (anchor, run) pairs of its documents by bucket. An anchor that two
   documents of a task share is answered there and sent once. A bucket says which runs
   have an anchor of another document, too, and which anchors have over HOT_RUNS runs.
2. Only these runs have their bytes sent, by anchor. Of equal runs in a task the smallest
   document's is sent; the others are removed on the spot. So a passage that a third of all
   documents have is one record a task. Runs of hot anchors (a string that many different
   texts stand around) are sent window by window, by the hash of the whole window.
3. A bucket lays its different runs one after another and builds their suffix array by
   two-stage sorting (see _suffixes), down to LENGTH bytes. Adjacent common prefixes of
   LENGTH group equal windows; each group's smallest document keeps its own.
4. The removed windows return to their documents' texts.

Hashes only bring strings together: wherever runs or windows count as equal, their bytes are
compared. The numbers of buckets and groups go by the bytes of the texts.

Text is shuffled only for documents that have a shared anchor (picked by a bitmap of fixed
size), and nothing of the others but their ids.

Cases: a null text is empty; texts shorter than LENGTH keep all; strings that repeat only
within their document stay; repeated rows (same doc_id and text) are one document; rows of
the same doc_id with different texts are told apart by a hash of the text and don't remove
one another; a null doc_id is smaller than any other (equal to -2**63); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import Buffer, chunks, mix, text_chunks, texts_of
from ._blobs import ROWS, batch_of, blobs_of, bucket_of, had_by_two, joined, pack, slices, unpack
from ._spark import PICK_BITS, done_with, partitions, picked, roomy_heap, tasks_for, text_bytes, written
from ._suffixes import common_prefixes, suffix_array, words_at

LENGTH = 50
ANCHOR = 26
#: Runs that a task packs at a time; bytes of text that it has as arrays, and of a suffix array.
FLUSH, TEXT_BYTES, BLOCK_BYTES = 1 << 19, 1 << 19, 1 << 19
#: Bytes of text of a group of documents, and whose anchors are a bucket's; runs of an anchor that is hot.
GROUP_TEXT, BUCKET_TEXT, HOT_RUNS = 2 << 20, 2 << 20, 1 << 16
_LONGEST_RUN = 255
#: What a null doc_id counts as: it is smaller than any other.
_NO_ID = -(1 << 63)
_rng = np.random.Generator(np.random.PCG64(50))
_ODD = _rng.integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors_at(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on: of the words of eight bytes that cover them."""
    n = max(len(data) - ANCHOR + 1, 0)
    if not n:
        return np.zeros(0, np.uint64)
    words = mix(np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)) ^ _ODD[3])
    out = np.zeros(n, np.uint64)
    for at, odd in zip((0, 8, 16, ANCHOR - 8), _ODD):
        out += words[at : at + n] * odd
    return out


def exact(hashes: np.ndarray, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of strings of data: equal where, and only where, the strings are. Their hashes say which to compare."""
    _, head, number = np.unique(hashes, return_index=True, return_inverse=True)
    other = np.flatnonzero(head[number] != np.arange(len(number)))
    first = head[number[other]]
    if (lengths[other] == lengths[first]).all() and (data[_ranges(begins[other], lengths[other])] == data[_ranges(begins[first], lengths[other])]).all():
        return number
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a : a + n].tobytes(), len(known)) for a, n in zip(begins.tolist(), lengths.tolist())], np.int64)


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: (text, first window, windows, anchor)."""
    buffer = Buffer(texts)
    n = len(buffer.data)
    none = np.zeros(0, np.int64)
    if n <= length:
        return none, none, none, none.astype(np.uint64)
    least = anchors_at(buffer.data)
    # least of the hashes at p .. p + span - 1, by doubling
    span, reach = length - ANCHOR + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    windows = np.maximum(np.diff(buffer.starts) - length, 0)
    some = windows > 0
    turns = np.zeros(len(least) + 1, np.int8)
    turns[buffer.starts[:-1][some]] = 1
    turns[(buffer.starts[:-1] + windows)[some]] = -1
    whole = np.cumsum(turns, dtype=np.int8).view(bool)
    edge = np.ones(len(least) + 1, bool)  # two texts have places that begin no window between them
    edge[1:-1] = (least[1:] != least[:-1]) | (whole[1:-1] != whole[:-2])
    cuts = np.flatnonzero(edge)
    mine = whole[cuts[:-1]]
    first, size = cuts[:-1][mine], np.diff(cuts)[mine]
    if len(size) and size.max() > _LONGEST_RUN:  # periodic text
        parts = -(-size // _LONGEST_RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + step * _LONGEST_RUN, np.minimum(np.repeat(size, parts) - step * _LONGEST_RUN, _LONGEST_RUN)
    text = np.searchsorted(buffer.starts, first, "right") - 1
    return text, first - buffer.starts[text], size, least[first]


def _answers(owner: np.ndarray, first: np.ndarray, count: np.ndarray, groups: int) -> list[tuple[int, bytes]]:
    """(group of documents, blob of their runs)."""
    group = (owner % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((first, owner, group))
    owner, first, count = owner[order], first[order], count[order]
    return [(g, pack((owner[a:b], 5), (first[a:b], 4), (count[a:b], 1))) for g, a, b in slices(group[order])]


def _removals(owner: np.ndarray, doc_id: np.ndarray, first: np.ndarray, count: np.ndarray, groups: int) -> list[tuple[int, bytes]]:
    """As _answers(), with the documents' ids."""
    group = (owner % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((first, doc_id, owner, group))
    owner, doc_id, first, count = owner[order], doc_id[order], first[order], count[order]
    return [(g, pack((owner[a:b], 5), (doc_id[a:b], 8), (first[a:b], 4), (count[a:b], 4))) for g, a, b in slices(group[order])]


def emit_anchors(batches: Iterator[pa.RecordBatch], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: anchors for a bucket (count 0: two documents of the task have it, in as many runs as `first` says). Kind 1: runs that this task knows to be shared, for a group of documents."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        owner, first, count, value = (np.concatenate([h[i] for h in held]) for i in range(4))
        held.clear()
        order = np.argsort(value)
        owner, first, count, value = owner[order], first[order], count[order], value[order]
        shared, start = had_by_two(value, owner, np.zeros(len(value), bool))
        rows = [(g, 1, blob) for g, blob in _answers(owner[shared], first[shared], count[shared], groups)]
        sent = ~shared | start  # one for all of a shared anchor
        count[shared] = 0
        first[start] = np.where(shared[start], np.diff(np.concatenate([np.flatnonzero(start), [len(start)]])), first[start])
        owner, first, count, value = owner[sent], first[sent], count[sent], value[sent]
        rows += [(b, 0, pack((value[x:y], 5), (owner[x:y], 5), (first[x:y], 4), (count[x:y], 1))) for b, x, y in slices(bucket_of(value, buckets))]
        return batch_of(rows)

    for batch, texts in text_chunks(batches, "text", TEXT_BYTES):
        text, first, count, value = runs(texts)
        held.append((batch.column("owner").to_numpy().astype(np.uint64)[text], first.astype(np.uint32), count.astype(np.uint8), value))
        size += len(value)
        if size >= FLUSH:
            yield flush()
            size = 0
    if size:
        yield flush()


#: The group of what isn't for a group of documents: hot anchors.
_HOT = -1


def find_shared(group: pa.Table, groups: int, hot_runs: int) -> pa.Table:
    """The runs of a bucket whose anchor another document has, too, by group of documents; and the places of hot anchors in a bitmap."""
    value, owner, first, count = joined(blobs_of(group, 0), 4)
    order = np.argsort(value)
    value, owner, first, count = value[order], owner[order], first[order], count[order]
    shared, start = had_by_two(value, owner, count == 0)
    n = np.add.reduceat(np.where(count == 0, first, 1), np.flatnonzero(start)) if len(value) else np.zeros(0, np.int64)
    hot = value[start][n > hot_runs]
    shared &= count > 0
    out = _answers(owner[shared], first[shared], count[shared], groups)
    out += [(_HOT, pack((hot % np.uint64(PICK_BITS), 4)))] if len(hot) else []
    return pa.table({"grp": pa.array([g for g, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})


def _rows_with(docs: pa.Table, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in owner, row of docs) of equal owners; more than one row may have an owner."""
    have = docs.column("owner").to_numpy().astype(np.uint64)
    order = np.argsort(have, kind="stable")
    have = have[order]
    low, high = np.searchsorted(have, owner, "left"), np.searchsorted(have, owner, "right")
    n = high - low
    place = np.repeat(np.arange(len(owner)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return place, order[low[place] + step]


def _once(docs: pa.Table) -> pa.Table:
    """One row of each (doc_id, owner): repeated rows are one document."""
    keys = list(zip(docs.column("doc_id").to_pylist(), docs.column("owner").to_pylist()))
    seen: set = set()
    keep = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
    return docs if len(keep) == len(keys) else docs.take(keep)


def emit_segments(docs: pa.Table, replies: pa.Table, buckets: int, groups: int, hot: bytes | None) -> pa.Table:
    """The bytes of the shared runs of a group of documents. Kind 0: different runs with the smallest document that has each, for a bucket by anchor. Kind 1: windows that are removed for sure. Kind 2: different windows of hot anchors (a bitmap), for a bucket by hash."""
    docs = _once(docs)
    owner, first, count = joined(replies.column("blob").to_pylist(), 3)
    place, row = _rows_with(docs, owner) if docs.num_rows else (np.zeros(0, np.int64),) * 2
    if not len(place):
        return pa.Table.from_batches([batch_of([])])
    texts = [t for c in docs.column("text").chunks for t in texts_of(c)]
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    owner, first, count = owner[place], first[place].astype(np.int64), count[place].astype(np.int64)
    fits = first + count + LENGTH - 1 <= sizes[row]  # a run of another document that shares the owner may not
    order = np.flatnonzero(fits)[np.argsort(row[fits], kind="stable")]
    owner, first, count, row = owner[order], first[order], count[order], row[order]
    ids = docs.column("doc_id").to_numpy()
    rows: list[tuple[int, int, bytes]] = []
    for part in chunks(sizes.tolist(), 4 * TEXT_BYTES):  # what a task has as arrays
        some = slice(*np.searchsorted(row, [part.start, part.stop]))
        if some.stop > some.start:
            at = np.concatenate([[0], np.cumsum(sizes[part])])
            rows += _segments(b"".join(texts[part]), owner[some], ids[row[some]], first[some], count[some], at[row[some] - part.start] + first[some], buckets, groups, hot)
    return pa.Table.from_batches([batch_of(rows)])


def _smallest(number: np.ndarray, owner: np.ndarray, doc_id: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by number and document, where in it a number begins, and which entries are of their number's smallest document."""
    order = np.lexsort((first, owner, doc_id, number))
    d = doc_id[order]
    start = np.ones(len(order), bool)
    start[1:] = number[order][1:] != number[order][:-1]
    return order, start, d == d[start][np.cumsum(start) - 1]


def _segments(whole: bytes, owner: np.ndarray, doc_id: np.ndarray, first: np.ndarray, count: np.ndarray, begins: np.ndarray, buckets: int, groups: int, hot: bytes | None) -> list[tuple[int, int, bytes]]:
    """emit_segments() for some documents at once; begins: where in `whole` the runs begin."""
    buffer = Buffer([whole])
    data = buffer.data
    least = anchors_at(data)
    anchors = least[begins]
    for k in range(1, LENGTH - ANCHOR + 1):
        np.minimum(anchors, least[begins + k], out=anchors)
    rows: list[tuple[int, int, bytes]] = []
    if hot is not None:
        bits = np.frombuffer(hot, np.uint8)
        place = (anchors & np.uint64(PICK_BITS - 1)).astype(np.int64)
        is_hot = bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
        n = count[is_hot]
        step = _ranges(np.zeros(len(n), np.int64), n)
        at, w_owner, w_id, w_first = (np.repeat(x[is_hot], n) for x in (begins, owner, doc_id, first))
        at, w_first = at + step, w_first + step
        hashes = buffer.hashes(at, at + LENGTH)
        order, start, stays = _smallest(exact(hashes, data, at, np.full(len(at), LENGTH)), w_owner, w_id, w_first)
        gone = order[~stays]
        rows += [(g, 1, blob) for g, blob in _removals(w_owner[gone], w_id[gone], w_first[gone], np.ones(len(gone), np.int64), groups)]
        stay = order[stays][np.argsort(hashes[order[stays]], kind="stable")]
        for b, x, y in slices(bucket_of(hashes[stay], buckets)):
            k = stay[x:y]
            rows.append((b, 2, pack((hashes[k], 8), (w_id[k], 8), (w_owner[k], 5), (w_first[k], 4), (data[_ranges(at[k], np.full(len(k), LENGTH))], 1))))
        cold = ~is_hot
        owner, doc_id, first, count, begins, anchors = (x[cold] for x in (owner, doc_id, first, count, begins, anchors))
        if not len(owner):
            return rows
    sizes = count + LENGTH - 1
    order, start, stays = _smallest(exact(buffer.hashes(begins, begins + sizes), data, begins, sizes), owner, doc_id, first)
    segment = np.cumsum(start) - 1
    gone = order[~stays]
    rows += [(g, 1, blob) for g, blob in _removals(owner[gone], doc_id[gone], first[gone], count[gone], groups)]
    head = order[start]
    by = np.argsort(anchors[head], kind="stable")
    stay, of = order[stays], segment[stays]  # sorted by segment
    bounds = np.searchsorted(of, np.arange(len(head) + 1))
    for b, x, y in slices(bucket_of(anchors[head][by], buckets)):
        seg = by[x:y]
        n = bounds[seg + 1] - bounds[seg]
        member = stay[_ranges(bounds[seg], n)]
        long = sizes[head[seg]]
        rows.append((b, 0, pack((anchors[head[seg]], 4), (long, 4), (data[_ranges(begins[head[seg]], long)], 1), (n, 4), (doc_id[member], 8), (owner[member], 5), (first[member], 4))))
    return rows


def judge_windows(group: pa.Table, groups: int) -> pa.Table:
    """The removed windows among those of hot anchors that a bucket has."""
    hashes, doc_id, owner, first, data = joined(blobs_of(group, 2), 5)
    doc_id, first = doc_id.view(np.int64), first.astype(np.int64)
    n = len(hashes)
    order, _, stays = _smallest(exact(hashes, data.astype(np.uint8), np.arange(n) * LENGTH, np.full(n, LENGTH)), owner, doc_id, first)
    gone = order[~stays]
    out = _removals(owner[gone], doc_id[gone], first[gone], np.ones(len(gone), np.int64), groups)
    return pa.table({"grp": pa.array([g for g, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each start and length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def judge_segments(group: pa.Table, groups: int) -> pa.Table:
    """The removed windows of a bucket's runs, by group of documents."""
    anchor, sizes, data, n, doc_id, owner, first = joined(blobs_of(group, 0), 7)
    sizes, n, data = sizes.astype(np.int64), n.astype(np.int64), data.astype(np.uint8)
    doc_id, first = doc_id.view(np.int64), first.astype(np.int64)
    begins, at = np.cumsum(sizes) - sizes, np.cumsum(n) - n
    order = np.argsort(anchor, kind="stable")
    out: list[tuple[int, bytes]] = []
    # blocks of about BLOCK_BYTES; equal windows have equal anchors, so they never are in two blocks
    ends = np.cumsum(sizes[order])
    low = 0
    while low < len(order):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_BYTES, "right"))
        high = max(high, low + 1)
        while high < len(order) and anchor[order[high]] == anchor[order[high - 1]]:
            high += 1
        some = order[low:high]
        members = _ranges(at[some], n[some])
        block = _judge(data[_ranges(begins[some], sizes[some])], sizes[some], np.repeat(np.arange(len(some)), n[some]), doc_id[members])
        if block is not None:
            m, step, length = block
            m = members[m]
            out += _removals(owner[m], doc_id[m], first[m] + step, length, groups)
        low = high
    return pa.table({"grp": pa.array([g for g, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})


def _judge(data: np.ndarray, sizes: np.ndarray, which: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of segments (data, sizes) and the documents that have each (which, doc_id): runs of windows of which a smaller document has an equal one, as (member, first window, windows)."""
    begins = np.cumsum(sizes) - sizes
    # equal segments are laid down once
    number = exact(Buffer([data.tobytes()]).hashes(begins, begins + sizes), data, begins, sizes)
    _, kept, same_as = np.unique(number, return_index=True, return_inverse=True)
    data = data[_ranges(begins[kept], sizes[kept])]
    sizes, which = sizes[kept], same_as[which]
    begins = np.cumsum(sizes) - sizes
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc_id)
    windows = sizes - LENGTH + 1
    segment = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.arange(len(data)) - begins[segment] < windows[segment]
    order = suffix_array(data, LENGTH)
    order = order[whole[order]]
    new = common_prefixes(order, words_at(data), LENGTH) < LENGTH
    smallest = np.zeros(len(data), np.int64)
    smallest[order] = np.minimum.reduceat(least[segment[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    n = windows[which]
    member = np.repeat(np.arange(len(which)), n)
    step = _ranges(np.zeros(len(n), np.int64), n)
    gone = smallest[begins[which][member] + step] < doc_id[member]
    edge = np.ones(len(gone), bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (member[1:] != member[:-1])
    at = np.flatnonzero(edge)
    length = np.diff(np.concatenate([at, [len(gone)]]))
    bad = gone[at]
    return (member[at[bad]], step[at[bad]], length[bad]) if bad.any() else None


_RESULT = "doc_id long, owner long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"


def cut_out(docs: pa.Table, replies: pa.Table) -> pa.Table:
    """What is left of a group of documents."""
    docs = _once(docs)
    owner, doc_id, first, count = joined(replies.column("blob").to_pylist(), 4)
    names = ["doc_id", "owner", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"]
    out: list[list] = [[] for _ in names]
    if docs.num_rows and len(owner):
        place, row = _rows_with(docs, owner)
        mine = docs.column("doc_id").to_numpy()[row] == doc_id[place].view(np.int64)
        place, row = place[mine], row[mine]
        first, count = first[place].astype(np.int64), count[place].astype(np.int64)
        texts = [t for c in docs.column("text").chunks for t in texts_of(c)]
        order = np.argsort(row, kind="stable")
        for r, x, y in slices(row[order]):
            some, text = order[x:y], texts[r]
            turns = np.zeros(len(text) + 1, np.int64)
            np.add.at(turns, first[some], 1)
            np.add.at(turns, first[some] + count[some] + LENGTH - 1, -1)
            gone = np.cumsum(turns[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            values = (docs.column("doc_id")[r].as_py(), docs.column("owner")[r].as_py(), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2].tolist(), edges[1::2].tolist())
            for column, value in zip(out, values):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds)})


def _firsts(read: DataFrame) -> DataFrame:
    """whole (SHA-256 of the text), first_id, first_owner and n of each different text of read: the smallest document that has it, and in how many rows it is."""
    first = F.min(F.struct("doc_id", "owner"))
    found = read.select(F.unhex(F.sha2("text", 256)).alias("whole"), "doc_id", "owner").groupBy("whole").agg(first.alias("f"), F.count("*").alias("n"))
    return written(found.select("whole", F.col("f.doc_id").alias("first_id"), F.col("f.owner").alias("first_owner"), "n"), "firsts")


def _unrepeated(read: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows of read without those (a few stay) whose text a smaller document has, too. These lose all, and no window's smallest document is among them."""
    return picked(read, F.col("owner"), firsts, F.col("first_owner"))


def _bitmap(rows: DataFrame) -> bytes | None:
    """The bitmap of the places in `rows` (blobs), of PICK_BITS bits; None if there are none."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(blob)[0].astype(np.int64))], names=["h"])

    if rows.isEmpty():
        return None
    parts = rows.select("blob").mapInArrow(places, "h long").select(F.expr("h div 32768").alias("part"), (F.col("h") % 32768).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()  # PICK_BITS / 2**15 rows of 4 KB, at most
    out = bytearray(PICK_BITS // 8)
    for part, bits in parts:
        out[4096 * part : 4096 * (part + 1)] = bytes(bits).ljust(4096, b"\0")
    return bytes(out)


def passages(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts and span_ends (bytes, ends exclusive) of every row of docs."""
    with roomy_heap(docs.sparkSession):
        return _passages(docs, hot_runs)


def _passages(docs: DataFrame, hot_runs: int) -> DataFrame:
    spark = docs.sparkSession
    size = text_bytes(docs)
    groups, buckets = (max(4 * partitions(spark), -(-size // each)) for each in (GROUP_TEXT, BUCKET_TEXT))
    tasks = tasks_for(spark, 2 * size)
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), text.alias("text"))
    # 40 bits that stand for a document; where two share them, both are looked at
    read = read.select("own_id", "doc_id", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)).alias("owner"), "text")
    to = F.when(F.col("kind") == 0, F.col("bucket")).when(F.col("kind") == 2, F.col("bucket") + buckets).otherwise(-1 - F.col("bucket")).alias("to")

    def answered(work):
        def run(group: pa.Table) -> pa.Table:
            kind = group.column("kind")[0].as_py()
            if kind == 1:  # known already
                return pa.table({"grp": group.column("bucket"), "blob": group.column("blob")})
            return (judge_windows if kind == 2 else work)(group, groups)

        return run

    firsts = _firsts(read)
    anchors = _unrepeated(read, firsts).select("owner", "text").mapInArrow(lambda b: emit_anchors(b, buckets, groups), ROWS)
    found = written(anchors.select("*", to).repartition(tasks, "to").groupBy("to").applyInArrow(answered(lambda group, n: find_shared(group, n, hot_runs)), "grp int, blob binary"), "shared")
    shared, hot = found.where(F.col("grp") != _HOT), _bitmap(found.where(F.col("grp") == _HOT))

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.unique(unpack(b)[0]) for b in batch.column("blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *some])).astype(np.int64))], names=["owner"])

    def of(replies: DataFrame) -> DataFrame:
        """The documents that have replies, with their group."""
        with_replies = replies.select("blob").mapInArrow(owners, "owner long")
        return picked(read.select("doc_id", "owner", "text"), F.col("owner"), with_replies, F.col("owner")).withColumn("grp", F.pmod("owner", F.lit(groups)).cast("int"))

    def together(replies: DataFrame):
        """The documents that have replies beside these, by group."""
        return of(replies).repartition(tasks, "grp").groupBy("grp").cogroup(replies.repartition(tasks, "grp").groupBy("grp"))

    shown = None if hot is None else spark.sparkContext.broadcast(hot)  # PICK_BITS / 8 bytes
    segments = together(shared).applyInArrow(lambda a, b: emit_segments(a, b, buckets, groups, shown and shown.value), ROWS)
    removed = written(segments.select("*", to).repartition(tasks, "to").groupBy("to").applyInArrow(answered(judge_segments), "grp int, blob binary"), "removed")
    done_with(found)
    cut = together(removed).applyInArrow(cut_out, _RESULT)
    every = read.select("own_id", "doc_id", "owner", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("hex"))
    joined = every.join(cut, ["doc_id", "owner"], "left").withColumn("whole", F.unhex("hex")).join(firsts.where("n > 1").select("whole", "first_id"), "whole", "left")
    none = F.array().cast("array<bigint>")
    copy = (F.col("first_id") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH)
    values = {
        "n_removed": (F.col("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long")),
        "n_spans": (F.lit(1).cast("long"), F.coalesce("n_spans", F.lit(0)).cast("long")),
        "kept_sha256": (F.lit(hashlib.sha256(b"").hexdigest()), F.coalesce("kept_sha256", "hex")),
        "span_starts": (F.array(F.lit(0).cast("long")), F.coalesce("span_starts", none)),
        "span_ends": (F.array("n_bytes"), F.coalesce("span_ends", none)),
    }
    return joined.select(F.col("own_id").alias("doc_id"), "n_bytes", *[F.when(copy, whole).otherwise(part).alias(name) for name, (whole, part) in values.items()])


def op5(docs: DataFrame) -> DataFrame:
    return passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
firsts AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p, p > lag(p, 1, -100) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS fresh FROM windows JOIN firsts USING (x) WHERE doc_id > first),
runs AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gone),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
pieces AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
