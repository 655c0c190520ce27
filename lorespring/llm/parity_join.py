"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles. Two sets A and B of n and m
shingles link when their Jaccard similarity is at least 0.8, so m is within a quarter of
n and their symmetric difference is at most d = (n + m) / 9.

Sketch: each shingle flips one bit, so the Hamming distance of two sketches is a lower
bound of the symmetric difference. The sketch used for joining is as wide as the 64-bit
hash allows and kept sparsely: it is cut into P pieces, and a piece is known by the XOR
of the (scrambled) positions that were flipped in it. P exceeds the largest d of a size
band, so of two sets that link at least P - d pieces are equal (pigeonhole). A size band
spans a factor of 1.25; a set joins in its own band and in the band of its smallest
partners. Sets of up to SMALL shingles have every flipped bit as a piece of its own.

Empty pieces would be equal for no reason. A set with so many of them that a match of
filled pieces isn't certain joins under further hash seeds too, and if none serves, with
its empty pieces as well. So a link is never lost.

Steps:
1. Sets are digested; equal sets are one class from here on.
2. Each task emits the pieces of its sets, packed and sorted by bucket. A piece that two
   sets of a task share is answered there and sent once. A bucket says how many of a set's
   pieces some other set has, too: with fewer than P - d of them a set links with nothing
   and is out. That leaves sets that have near copies, and few others, whatever passages
   they share.
3. What is left is joined by pieces to stars (never to pairs), whose connected components
   hold all links. A component is compared in blocks of bounded size: dense parity
   sketches of the blocks, all Hamming distances of a row at once, and an exact
   intersection of every pair within reach. Of a block's links only the number that each
   set has and a spanning forest are written, never the pairs.

A class is known by a number of its own and a row by its file and place, never by doc_id.

Cases: null, empty and blank texts have an empty set and link with nothing; fewer than 5
words are one element, the whole sequence; repeated rows and equal texts are members of
one class; rows of one doc_id with different texts are documents of their own; a row
without doc_id is a row like any other, but the smallest doc_id of its component is among
those that there are, and null if there is none; an empty table gives no rows; other
columns are not read. Hashes of shingles have 64 bits, digests of sets 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import mix, shingle_sets, text_chunks
from ._blobs import ROWS, batch_of, blobs_of, bucket_of, had_by_two, pack, slices, unpack
from ._graph import components
from ._spark import done_with, located, partitions, picked, tasks_for, text_bytes, without, written

WIDTH = 5
#: Sets of up to so many shingles have a piece for each.
SMALL = 128
#: Hash seeds that a set with many empty pieces is joined under, at most.
SEEDS = 12
#: Entries that a task packs at a time; shingles of a block of a component.
FLUSH, BLOCK_SHINGLES = 1 << 19, 1 << 20
#: Bytes of text that a task has as arrays at a time; of text whose pieces are a bucket's.
TEXT_BYTES, BUCKET_TEXT = 1 << 19, 8 << 20
_LOW = np.uint64((1 << 48) - 1)

_BOUNDS = [SMALL]
while _BOUNDS[-1] < 1 << 40:
    _BOUNDS.append(_BOUNDS[-1] * 5 // 4)
_BOUNDS = np.array(_BOUNDS, np.int64)


def least_partner(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n)"""
    return (4 * n + 4) // 5


def band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BOUNDS, n, "left")


def pieces_of(band_: np.ndarray) -> np.ndarray:
    """Pieces of a band (not the band of small sets): its largest difference and a quarter more."""
    most = (_BOUNDS[band_] + _BOUNDS[band_] * 5 // 4) // 9
    return most + (most + 3) // 4 + 1


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each start and length, one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def keys_of(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The piece keys of some sets.

    Gives, for each role (a set in a band under a seed): its set, a number for band and seed, and how many of its keys a set that links must share, at least; and for each key: its role's index and its value.
    """
    n = np.diff(offsets)
    sets, bands = [], []
    own, low = band(n), band(np.maximum(least_partner(n), 1))
    for down in (0, 1):
        has = np.flatnonzero((n > 0) & (own - down >= low))
        sets.append(has)
        bands.append((own - down)[has])
    of, at = np.concatenate(sets), np.concatenate(bands)
    out_set, out_role, out_need, key_role, key = [], [], [], [], []
    base = 0

    small = np.flatnonzero(at == 0)
    if len(small):
        s = of[small]
        out_set.append(s)
        out_role.append(np.zeros(len(s), np.int64))
        out_need.append(least_partner(n[s]))
        key_role.append(np.repeat(np.arange(len(s)), n[s]))
        key.append(mix(hashes[_ranges(offsets[s], n[s])] ^ np.uint64(0x51AB)))
        base = len(s)

    big = at > 0
    of, at = of[big], at[big]
    for seed in range(SEEDS + 1):
        if not len(of):
            break
        last = seed == SEEDS
        p = pieces_of(at)
        first = np.cumsum(p) - p
        idx = _ranges(offsets[of], n[of])
        role = np.repeat(np.arange(len(of)), n[of])
        h = mix(hashes[idx] ^ np.uint64(0x9E3779B97F4A7C15 * (seed % SEEDS + 1) & (2**64 - 1)))
        piece = first[role] + (((h >> np.uint64(32)) * p[role].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(p.sum(), np.uint64)
        np.bitwise_xor.at(total, piece, mix(h))
        filled = np.zeros(len(total), bool)
        filled[piece] = True
        piece_role = np.repeat(np.arange(len(of)), p)
        empty = p - np.bincount(piece_role[filled], minlength=len(of))
        # in its own band a set meets sets of up to 5/4 of its size, as they come down to it; where it comes down itself, sets of up to the band's bound (larger ones it meets above)
        reach = np.where(n[of] <= _BOUNDS[at], n[of] + n[of] * 5 // 4, n[of] + _BOUNDS[at]) // 9
        need = p - reach - empty
        sent = filled
        if last:
            sent, need = np.ones(len(total), bool), p - reach
        out_set.append(of)
        out_role.append(at * (SEEDS + 1) + seed)
        out_need.append(np.maximum(need, 1))
        within = (np.arange(len(total)) - first[piece_role]).astype(np.uint64)
        salt = (at * (SEEDS + 1) + seed).astype(np.uint64)[piece_role] * np.uint64(0xD6E8FEB86659FD93)
        key_role.append(base + piece_role[sent])
        key.append(mix(total[sent] ^ mix(within[sent] + salt[sent])))
        base += len(of)
        of, at = of[need <= 0], at[need <= 0]
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return cat(out_set, np.int64), cat(out_role, np.int64), cat(out_need, np.int64), cat(key_role, np.int64), cat(key, np.uint64)


def digests_of(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set, as rows of int64."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    has = np.flatnonzero(np.diff(offsets) > 0)
    for j, salt in enumerate((0x1234567, 0x89ABCDE)):
        if len(has):
            out[has, j] = mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), offsets[:-1][has]) + np.diff(offsets)[has].astype(np.uint64))
    return out.view(np.int64)


def owner_of(digest: np.ndarray, role: np.ndarray) -> np.ndarray:
    """A 48-bit number for a set in a role. Sets that share one are both kept when either is, which costs work; two that link and share one (a chance of 2**-48) would pass for one set."""
    return mix(digest.astype(np.uint64) ^ mix(role.astype(np.uint64))) & _LOW


def emit_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the sets of a task. Kind 0: their keys, for a bucket (owner 0: two or more sets of the task have it). Kind 1: keys that the task answers itself, as owners and counts. Kind 2: owners, digests and needs."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    seen: set[int] = set()
    sizes = [0, 0]

    def flush() -> pa.RecordBatch:
        owner, digest, need = (np.concatenate([h[i] for h in held]) for i in range(3))
        key, who = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        held.clear(), seen.clear()
        sizes[:] = [0, 0]
        order = np.argsort(key)
        key, who = key[order], who[order]
        shared, start = had_by_two(key, owner[who], np.zeros(len(key), bool))
        answered = np.bincount(who[shared], minlength=len(owner))
        some = np.flatnonzero(answered)
        sent = ~shared | start
        value, by = key[sent], np.where(shared[sent], 0, owner[who[sent]])
        rows = [(b, 0, pack((value[x:y], 5), (by[x:y], 6))) for b, x, y in slices(bucket_of(value, buckets))]
        place = int(key[0] % np.uint64(buckets))
        rows += [(place, 1, pack((owner[some], 6), (answered[some], 5))), (place, 2, pack((owner, 6), (digest.astype(np.uint64), 8), (need, 5)))]
        return batch_of(rows)

    for _, texts in text_chunks(batches, "text", TEXT_BYTES):
        offsets, hashes = shingle_sets(texts, WIDTH, lower=True)
        digests = digests_of(offsets, hashes)[:, 0]
        # equal sets of a task are sent once
        _, first = np.unique(digests, return_index=True)
        fresh = np.array([i for i in first if offsets[i + 1] > offsets[i] and int(digests[i]) not in seen], np.int64)
        if not len(fresh):
            continue
        seen.update(digests[fresh].tolist())
        lengths = offsets[fresh + 1] - offsets[fresh]
        of, role, need, key_role, key = keys_of(np.concatenate([[0], np.cumsum(lengths)]), hashes[_ranges(offsets[fresh], lengths)])
        held.append((owner_of(digests[fresh][of], role), digests[fresh][of], need, key, key_role + sizes[0]))
        sizes[0] += len(of)
        sizes[1] += len(key)
        if sizes[1] >= FLUSH:
            yield flush()
    if sizes[1]:
        yield flush()


def count_shared(group: pa.Table) -> pa.Table:
    """Of one bucket: owners and how many of their keys other sets have, too (digest null); and sets with their owners and needs."""
    parts = [unpack(b) for b in blobs_of(group, 0)]
    owners, counts = [], []
    if parts:
        key, who = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        shared, _ = had_by_two(key, who, who == 0)
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (who[1:] == who[:-1])
        found, n = np.unique(who[shared & ~again & (who > 0)], return_counts=True)
        owners.append(found), counts.append(n.astype(np.uint64))
    for owner, n in map(unpack, blobs_of(group, 1)):
        owners.append(owner), counts.append(n)
    known = [unpack(b) for b in blobs_of(group, 2)]
    owner = np.concatenate([*owners, *(k[0] for k in known), np.zeros(0, np.uint64)]).astype(np.int64)
    n = np.concatenate([*counts, np.zeros(0, np.uint64)]).astype(np.int64)
    sets = len(owner) - len(n)
    digest = np.concatenate([*(k[1] for k in known), np.zeros(0, np.uint64)]).view(np.int64)
    need = np.concatenate([*(k[2] for k in known), np.zeros(0, np.uint64)]).astype(np.int64)
    return pa.table({"owner": owner, "n": np.concatenate([n, need]), "digest": pa.array(np.concatenate([np.zeros(len(n), np.int64), digest]), mask=np.arange(len(owner)) < len(owner) - sets)})


def emit_stars(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the sets left: packed keys with the smallest set of the task that has them (kind 0), and the task's own stars (kind 1)."""

    def of(parts: list) -> pa.RecordBatch:
        ids = np.concatenate([p[0] for p in parts])
        key, owner = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.lexsort((ids[owner], key))
        key, who = key[order], ids[owner][order]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        centre = who[start][np.cumsum(start) - 1]
        edges = np.unique(np.column_stack([who, centre])[who != centre], axis=0)
        value, first = key[start], who[start].astype(np.uint64)
        rows = [(b, 0, pack((value[x:y], 8), (first[x:y], 8))) for b, x, y in slices(bucket_of(value, buckets))]
        rows += [(int(key[0] % np.uint64(buckets)), 1, pack((edges[:, 0], 8), (edges[:, 1], 8)))]
        return batch_of(rows)

    parts, held, base = [], 0, 0
    for batch in batches:
        ids = batch.column("id").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in batch.column("shingles").to_pylist()]
        for k in range(0, len(sets), 200):
            some = sets[k : k + 200]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in some])]).astype(np.int64)
            of_set, _, _, key_role, key = keys_of(offsets, np.concatenate(some))
            parts.append((ids[k : k + 200][of_set], key, key_role + base))
            base += len(of_set)
            held += len(key)
            if held >= FLUSH:
                yield of(parts)
                parts, held, base = [], 0, 0
    if held:
        yield of(parts)


def join_stars(group: pa.Table) -> pa.Table:
    """Of one bucket: an edge from each set to the smallest that has the same key."""
    parts = [unpack(b) for b in blobs_of(group, 0)]
    edges = [np.column_stack([a, b]).view(np.int64) for a, b in map(unpack, blobs_of(group, 1))]
    if parts:
        key, who = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.int64)
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        centre = who[start][np.cumsum(start) - 1]
        edges.append(np.column_stack([who, centre])[who != centre])
    all_ = np.unique(np.concatenate([*edges, np.zeros((0, 2), np.int64)]), axis=0)
    return pa.table({"a": all_[:, 0], "b": all_[:, 1]})


def sketch(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Dense parity sketches: bit h mod bits of a row is flipped for each h of a set."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    lengths = [len(s) for s in sets]
    h = np.concatenate(sets) % np.uint64(bits)
    row = np.repeat(np.arange(len(sets)), lengths)
    np.bitwise_xor.at(out.reshape(-1), row * (bits // 64) + (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def links(ids: np.ndarray, sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of sets that link: ids, how much the sets that each links with weigh, and enough of the links to join what all of them join. side: 0 or 1; links are between different sides, or any if all sides are 2."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets, weights, side = ids[order], [sets[i] for i in order], weights[order].astype(np.int64), side[order]
    n = np.array([len(s) for s in sets], np.int64)
    bits = 1 << max(8, min(16, int(2 * n.max()).bit_length()))
    rows = sketch(sets, bits)
    names, number = np.unique(np.concatenate(sets), return_inverse=True)  # shingles by small numbers
    at = np.cumsum(n) - n
    mine = np.zeros(len(names), bool)
    total, up, forest = np.zeros(len(sets), np.int64), np.arange(len(sets)), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(sets) - 1):
        stop = np.searchsorted(n, n[i] * 5 // 4, "right")
        if stop <= i + 1:
            continue
        apart = np.bitwise_count(rows[i + 1 : stop] ^ rows[i]).sum(1, dtype=np.int64)
        near = i + 1 + np.flatnonzero((9 * apart <= n[i] + n[i + 1 : stop]) & ((side[i + 1 : stop] != side[i]) | (side[i] == 2)))
        if not len(near):
            continue
        mine[number[at[i] : at[i] + n[i]]] = True
        for k in range(0, len(near), 256):
            some = near[k : k + 256]
            both = np.add.reduceat(mine[number[_ranges(at[some], n[some])]].astype(np.int64), np.cumsum(n[some]) - n[some])
            some = some[100 * both >= 80 * (n[i] + n[some] - both)]
            total[i] += weights[some].sum()
            total[some] += weights[i]
            for j in some.tolist():
                x, y = root(i), root(j)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    forest.append((int(ids[i]), int(ids[j])))
        mine[number[at[i] : at[i] + n[i]]] = False
    has = total > 0
    return ids[has], total[has], forest


def compare(group: pa.Table) -> pa.Table:
    """Links within one component, or between two of its blocks: (a, others) and links (a, b)."""
    sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
    of, total, forest = links(group.column("id").to_numpy(), sets, group.column("members").to_numpy(), group.column("side").to_numpy())
    none = lambda k: pa.nulls(k, pa.int64())
    a, b = (pa.array([x[j] for x in forest], pa.int64()) for j in range(2))
    return pa.table({"a": pa.chunked_array([pa.array(of), a]), "others": pa.chunked_array([pa.array(total), none(len(a))]), "b": pa.chunked_array([none(len(of)), b])})


def _judged(docs: DataFrame) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """docs of located(), the names of its places, its rows (file, row, doc_id, n_shingles, digest, digest2), and of each class with a link or a second member: its digests, n_similar and the row that leads its component."""
    spark = docs.sparkSession
    placed, names = located(docs)
    size = text_bytes(docs)
    buckets, tasks = max(partitions(spark), -(-size // BUCKET_TEXT)), tasks_for(spark, 2 * size)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text", TEXT_BYTES):
            offsets, hashes = shingle_sets(texts, WIDTH, lower=True)
            two = digests_of(offsets, hashes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "row", "doc_id")), pa.array(np.diff(offsets)), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["file", "row", "doc_id", "n_shingles", "digest", "digest2"])

    read = placed.select(F.col(names[0]).alias("file"), F.col(names[1]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(read.mapInArrow(digest, "file long, row long, doc_id long, n_shingles long, digest long, digest2 long"), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("digest", "digest2").agg(first, F.count("*").alias("members"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    packed = read.select("text").mapInArrow(lambda b: emit_counts(b, buckets), ROWS).repartition(tasks, "bucket")
    counted = written(packed.groupBy("bucket").applyInArrow(count_shared, "owner long, n long, digest long"), "counted")
    counts = counted.where("digest IS NULL").groupBy("owner").agg(F.sum("n").alias("n"))
    left = counted.where("digest IS NOT NULL").withColumnRenamed("n", "need").join(counts, "owner").where("n >= need").select("digest").distinct()
    left = written(classes.join(left, "digest").select("id", "members", F.col("first.file").alias("file"), F.col("first.row").alias("row")), "left")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text", TEXT_BYTES):
            offsets, hashes = shingle_sets(texts, WIDTH, lower=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("members"), pa.array(np.diff(offsets)), pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "members", "n", "shingles"])

    here = [F.col("file"), F.col("row")]
    sets = written(picked(read.select("file", "row", "text"), here, left, here).join(left.hint("merge"), ["file", "row"]).select("id", "members", "text").mapInArrow(sets_of, "id long, members long, n long, shingles binary"), "left-sets")
    stars = sets.select("id", "shingles").mapInArrow(lambda b: emit_stars(b, buckets), ROWS)
    near = components(stars.groupBy("bucket").applyInArrow(join_stars, "a long, b long"))
    grouped = written(sets.join(near, sets["id"] == near["node"]).select("component", "id", "members", "n", "shingles"), "members")
    pairs = written(_compared(grouped), "links")
    done_with(counted, left, sets, grouped)

    linked = pairs.where("b IS NULL").groupBy("a").agg(F.sum("others").alias("others"))
    whole = components(pairs.where("b IS NOT NULL").select("a", "b"))
    known = classes.join(linked, classes["id"] == linked["a"], "left").join(whole, classes["id"] == whole["node"], "left")
    leads = known.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("lead"))
    known = known.join(leads, "component", "left")
    # classes of one row without links have nothing to tell
    known = known.select("digest", "digest2", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("lead", "first").alias("lead")).where("n_similar > 0")
    return placed, names, rows, known


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of every row of docs."""
    _, _, rows, known = _judged(docs)
    out = rows.join(known, ["digest", "digest2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("lead.doc_id", "doc_id").alias("component_id"))


def _compared(members: DataFrame) -> DataFrame:
    """Links within each component. One of up to BLOCK_SHINGLES shingles is one group; a larger one is cut into blocks by size band and hash, and each pair of blocks whose sizes can meet is a group."""
    sizes = members.groupBy("component").agg(F.sum("n").alias("total"))
    bounds = F.array(*[F.lit(int(b)) for b in _BOUNDS[:80]])
    level = F.size(F.filter(bounds, lambda b: b < F.col("n")))
    joined = members.join(sizes, "component")
    small = joined.where(F.col("total") <= BLOCK_SHINGLES).select("component", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("bx"), F.lit(0).alias("by"), "id", "members", "shingles", F.lit(2).alias("side"))
    large = joined.where(F.col("total") > BLOCK_SHINGLES).withColumn("level", level)
    per = large.groupBy("component", "level").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    cut = large.join(per, ["component", "level"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    up = per.select("component", (F.col("level") - 1).alias("level"), F.col("blocks").alias("above"))
    down = per.select("component", (F.col("level") + 1).alias("level"), F.col("blocks").alias("below"))
    cut = cut.join(up, ["component", "level"], "left").join(down, ["component", "level"], "left").drop("total")
    common = ["component", "id", "members", "shingles"]
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    # within a level: blocks x <= y; between a level and the next: every block of both
    same = cut.withColumn("other", F.explode(upto(F.col("blocks")))).select(*common, F.col("level").alias("x"), F.col("level").alias("y"), F.least("block", "other").alias("bx"), F.greatest("block", "other").alias("by"), F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    as_low = cut.withColumn("other", F.explode(upto(F.col("above")))).select(*common, F.col("level").alias("x"), (F.col("level") + 1).alias("y"), F.col("block").alias("bx"), F.col("other").alias("by"), F.lit(0).alias("side"))
    as_high = cut.withColumn("other", F.explode(upto(F.col("below")))).select(*common, (F.col("level") - 1).alias("x"), F.col("level").alias("y"), F.col("other").alias("bx"), F.col("block").alias("by"), F.lit(1).alias("side"))
    keys = ["component", "x", "y", "bx", "by"]
    order = [*keys, "id", "members", "shingles", "side"]
    groups = small.select(*order).unionByName(same.select(*order)).unionByName(as_low.select(*order)).unionByName(as_high.select(*order))
    return groups.groupBy(*keys).applyInArrow(compare, "a long, others long, b long")


def representatives(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each component one row stays, that of the smallest doc_id (any doc_id before a null one), then the first by file and place."""
    placed, names, rows, known = _judged(docs)
    found = rows.join(known, ["digest", "digest2"])
    return without(placed, names, found.where("NOT (file = lead.file AND row = lead.row)").select("file", "row"))


def op2(docs: DataFrame) -> DataFrame:
    return similar(docs)


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (n + m - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a AS doc_id, count(*) AS n_similar FROM links GROUP BY a), first AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(n_similar, 0) AS n_similar, least(s.doc_id, coalesce(c, s.doc_id)) AS component_id FROM sets s LEFT JOIN found USING (doc_id) LEFT JOIN first USING (doc_id)
"""
