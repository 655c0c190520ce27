"""Exact nearest neighbours by cosine similarity, and an inverted-file index that is kept as tables.

Queries of up to SENT bytes are sent to every worker. Each task runs its vectors past them,
a matrix product a block, and keeps the k best of each query; a grouped window keeps the k
best of those. So no vector is shuffled, and a task holds a block and its best. More queries
are packed into blocks, as are the vectors, and pairs of blocks meet in a join whose keys
are spread, as vectors mostly have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Vectors of a block; queries of a matrix product.
BLOCK, QUERY_BLOCK, ROWS = 4096, 512, 256
#: Bytes of query vectors (and of the numbers of the cells that each looks at) that are sent to every worker; parts that a length's blocks are spread over where there are more.
SENT, SPREAD = 32 << 20, 32


def _by_length(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of a batch of (id, vector). Rows with a null id or vector, an empty vector or a null in it are left out."""
    vectors = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    holes = np.bincount(row, flat.is_null().to_numpy(zero_copy_only=False), len(lengths))
    usable = (lengths > 0) & (holes == 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
    data = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for dim in np.unique(lengths[usable]).tolist():
        some = usable & (lengths == dim)
        out.append((dim, ids[some], data[some[row]].reshape(-1, dim)))
    return out


def _packed(vectors: DataFrame, id_: str, vector: str, block: int, prefix: str) -> DataFrame:
    """Rows (ids, dim, data) of up to `block` vectors of equal length."""
    names = [f"{prefix}ids", f"{prefix}dim", f"{prefix}data"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            while len(ids) >= least and len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([ids[:block].astype(np.int64).tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([data[:block].tobytes()], pa.binary())], names=names)
                ids, data = ids[block:], data[block:]
            if len(ids):
                held[dim] = [(ids, data)]

        for batch in batches:
            for dim, ids, data in _by_length(batch):
                held.setdefault(dim, []).append((ids, data))
                if sum(len(i) for i, _ in held[dim]) >= block:
                    yield from out(dim, block)
        for dim in list(held):
            yield from out(dim, 1)

    return vectors.select(F.col(id_).cast("long"), F.col(vector)).mapInArrow(pack, f"{prefix}ids binary, {prefix}dim int, {prefix}data binary")


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, dim)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "embedding", id_: str = "vec_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k vectors most similar to each query, ties by id. Only vectors of the query's length are compared; a zero vector has similarity 0; NaN is left out."""
    asked = _sent(queries, query_id, query_vector)
    if asked is None:
        return _best(_spread(_packed(vectors, id_, vector, BLOCK, "v_"), _packed(queries, query_id, query_vector, QUERY_BLOCK, "q_")), k, query_id, id_, least)
    shared = queries.sparkSession.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = {dim: _Nearest(*q, k, least) for dim, q in shared.value.items()}
        for batch in batches:
            for dim, ids, data in _by_length(batch):
                if dim in near:
                    near[dim].see(ids, data)
        for x in near.values():
            yield from x.found([query_id, id_, "similarity"])

    return _ranked(vectors.select(F.col(id_).cast("long"), F.col(vector)).mapInArrow(search, f"{query_id} long, {id_} long, similarity double"), k, query_id, id_)


def _sent(queries: DataFrame, query_id: str, query_vector: str) -> dict[int, tuple[np.ndarray, np.ndarray]] | None:
    """By length, ids and matrix of the queries; None if they have more than SENT bytes."""
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0))
    if (asked.agg(F.sum(F.size("vector").cast("long") + 1)).first()[0] or 0) * 8 > SENT:
        return None
    parts: dict[int, list] = {}
    for batch in asked.toArrow().to_batches():  # SENT bytes at most
        for dim, ids, data in _by_length(batch):
            parts.setdefault(dim, []).append((ids, data))
    return {dim: tuple(np.concatenate(x) for x in zip(*p)) for dim, p in parts.items()}


class _Nearest:
    """The k nearest of the vectors seen so far to each query, ties by id."""

    HELD = 1 << 20

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, least: float | None):
        self.ids, self.data, self.k = ids, data, k
        self.norms = np.sqrt((data * data).sum(1))
        self.floor = np.full(len(ids), -np.inf if least is None else least)  # what is less similar isn't among the k
        self.raised = np.zeros(len(ids), bool)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def see(self, ids: np.ndarray, data: np.ndarray, rows: np.ndarray | None = None) -> None:
        """rows: the queries that ask these vectors; None: all."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        for a in range(0, len(ids), BLOCK):
            v = data[a : a + BLOCK]
            norms = np.sqrt((v * v).sum(1))
            for b in range(0, len(rows), ROWS):
                some = rows[b : b + ROWS]
                both = self.norms[some][:, None] * norms[None, :]
                sim = np.round(np.divide(self.data[some] @ v.T, both, out=np.zeros_like(both), where=both > 0), 6) + 0.0
                sim[np.isnan(both) | np.isnan(sim)] = -np.inf
                if len(v) >= self.k and not self.raised[some].all():
                    edge = np.partition(sim, len(v) - self.k, axis=1)[:, len(v) - self.k]
                    self.floor[some] = np.maximum(self.floor[some], edge)
                    self.raised[some] = True
                q, at = np.nonzero((sim >= self.floor[some][:, None]) & (sim > -np.inf))
                self.held.append((some[q], ids[a + at], sim[q, at]))
                self.size += len(q)
                if self.size > self.HELD:
                    self._trim()

    def _trim(self) -> None:
        q, ids, sim = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -sim, q))
        q, ids, sim = q[order], ids[order], sim[order]
        start = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - start < self.k
        last = np.arange(len(q)) - start == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], sim[last])
        self.raised[q[last]] = True
        self.held = [(q[keep], ids[keep], sim[keep])]
        self.size = int(keep.sum())

    def found(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._trim()
            q, ids, sim = self.held[0]
            for a in range(0, len(q), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (self.ids[q].astype(np.int64), ids.astype(np.int64), sim)], names=names)


def _spread(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of blocks of one length: each block of vectors in one of SPREAD parts, each of queries in all."""
    part = F.pmod(F.xxhash64("v_ids"), F.lit(SPREAD)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    return vectors.withColumn("v_part", part).join(queries.withColumn("q_part", every).hint("merge"), (F.col("v_dim") == F.col("q_dim")) & (F.col("v_part") == F.col("q_part")))


def _best(pairs: DataFrame, k: int, query_id: str, id_: str, least: float | None = None) -> DataFrame:
    """The k best of pairs of blocks (v_ids, v_dim, v_data, q_ids, q_dim, q_data)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                near = _Nearest(np.frombuffer(row["q_ids"], np.int64), _matrix(row["q_data"], row["q_dim"]), k, least)
                near.see(np.frombuffer(row["v_ids"], np.int64), _matrix(row["v_data"], row["v_dim"]))
                yield from near.found([query_id, id_, "similarity"])

    return _ranked(pairs.select("v_ids", "v_dim", "v_data", "q_ids", "q_dim", "q_data").mapInArrow(search, f"{query_id} long, {id_} long, similarity double"), k, query_id, id_)


def _ranked(best: DataFrame, k: int, query_id: str, id_: str) -> DataFrame:
    order = W.Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(data: np.ndarray) -> np.ndarray:
    return data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-12)


def _centroids(data: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = data[rng.choice(len(data), min(cells, len(data)), replace=False)]
    for _ in range(rounds):
        near = (data @ out.T).argmax(1)
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        out[found] = np.add.reduceat(data[order], at, axis=0)
        out = _unit(out)
    return out


def _probes(data: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest cells hold `recall` of the k nearest of some of the vectors, by brute force among them."""
    asked = data[: min(len(data), 256)]
    nearest = np.argsort(-(asked @ data.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(place, (data @ centroids.T).argmax(1)[nearest], axis=1)
    return int(np.quantile(at, recall, method="higher")) + 1


class IvfIndex:
    """Vectors by the nearest of some centroids, as tables in a folder that all executors share, written once and searched often.

    Of each length of vectors, centroids (about the square root of how many there are, MOST_CELLS at most) are fitted on a bounded sample (FIT_ROWS); every vector is in the
    index, in blocks of its cell, so a cell that a third of all vectors are in is many blocks. How many cells a search looks at is measured on the sample when the index is
    built: so many that RECALL of the nearest are in them. Rows with a null id or vector, or an empty one, are left out; an empty table makes an index that finds nothing.
    """

    FIT_ROWS, MOST_CELLS, RECALL = 20_000, 4096, 0.97

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def loaded(self) -> bool:
        """Whether an index was built there."""
        _, fs = self._folder()
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/blocks/_SUCCESS"))

    def clear(self) -> None:
        at, fs = self._folder()
        fs.delete(at, True)

    def build(self, vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", cells: int | None = None, rounds: int = 8, seed: int = 3, k: int = 10) -> IvfIndex:
        """Replace what is there by an index of vectors. k: for how many neighbours the number of cells to look at is measured."""
        self.clear()
        usable = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0))
        counts = {r["dim"]: r["n"] for r in usable.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a length
        rows = []
        for dim, n in sorted(counts.items()):
            part = int(min(1.0, self.FIT_ROWS / n) * (1 << 20))
            sample = usable.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < part)).select("id", "vector").toArrow().sort_by("id")
            found = [data for b in sample.to_batches() for _, _, data in _by_length(b)]
            if found:
                data = _unit(np.concatenate(found))
                centroids = _centroids(data, cells or min(self.MOST_CELLS, math.isqrt(n) + 1), rounds, seed)
                probes = _probes(data, centroids, k, self.RECALL)
                rows += [(dim, c, probes, centroid.tolist()) for c, centroid in enumerate(centroids)]
        self.spark.createDataFrame(rows, "dim int, cell int, probes int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        blocks = self._blocks(usable, None, BLOCK, "v_")
        blocks.write.parquet(f"{self.path}/blocks")
        return self

    def __len__(self) -> int:
        """How many vectors there are."""
        return int(self.spark.read.parquet(f"{self.path}/blocks").agg(F.sum(F.octet_length("v_ids") / 8)).first()[0] or 0)

    def _known(self) -> dict[int, tuple[int, np.ndarray]]:
        """By length, how many cells a search looks at, and the centroids."""
        known: dict[int, tuple[int, list]] = {}
        for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("dim", "cell").collect():  # MOST_CELLS rows a length, at most
            known.setdefault(r["dim"], (r["probes"], []))[1].append(r["centroid"])
        return {dim: (n, np.array(c)) for dim, (n, c) in known.items()}

    def _blocks(self, rows: DataFrame, probes: int | None, block: int, prefix: str) -> DataFrame:
        """Rows (id, vector) packed by length and cell. probes: put each into so many of its nearest cells (0: as many as was measured); None: into its nearest."""
        shared = self.spark.sparkContext.broadcast(self._known())
        names = [f"{prefix}{x}" for x in ("dim", "cell", "ids", "data")]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                for (dim, cell), parts in held.items():
                    ids, data = (np.concatenate(x) for x in zip(*parts))
                    for k in range(0, len(ids), block):
                        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([ids[k : k + block].astype(np.int64).tobytes()], pa.binary()), pa.array([data[k : k + block].tobytes()], pa.binary())], names=names)
                held.clear()

            for batch in batches:
                for dim, ids, data in _by_length(batch):
                    if dim not in shared.value:
                        continue
                    measured, centroids = shared.value[dim]
                    n = 1 if probes is None else min(probes or measured, len(centroids))
                    like = data @ centroids.T
                    near = np.argpartition(-like, n - 1, axis=1)[:, :n] if n < len(centroids) else np.broadcast_to(np.arange(n), like.shape)
                    cell, row = near.reshape(-1), np.repeat(np.arange(len(ids)), n)
                    order = np.argsort(cell, kind="stable")
                    cuts = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                        some = row[order[a:b]]
                        held.setdefault((dim, int(cell[order[a]])), []).append((ids[some], data[some]))
                    size += data.nbytes * n
                    if size >= 64 << 20:
                        yield from out()
                        size = 0
            yield from out()

        return rows.mapInArrow(pack, f"{prefix}dim int, {prefix}cell int, {prefix}ids binary, {prefix}data binary")

    def search(self, queries: DataFrame, k: int, probes: int = 0, query_id: str = "query_id", query_vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
        """Approximate top_k() among vectors of a query's length: the blocks of its `probes` nearest cells (0: as many as was measured). Blocks stay where they are and are run past the queries that look at their cell; too many queries to send are joined with them on the cell."""
        stored = self.spark.read.parquet(f"{self.path}/blocks")
        asked = self._cells_of(_sent(queries, query_id, query_vector), probes)
        if asked is None:
            blocks = self._blocks(queries.select(F.col(query_id).cast("long"), F.col(query_vector)), probes, QUERY_BLOCK, "q_")
            return _best(blocks.join(stored, (F.col("q_dim") == F.col("v_dim")) & (F.col("q_cell") == F.col("v_cell"))), k, query_id, id_)
        shared = self.spark.sparkContext.broadcast(asked)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = {dim: _Nearest(ids, data, k, None) for dim, (ids, data, _) in shared.value.items()}
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    cells = shared.value[row["v_dim"]][2] if row["v_dim"] in near else {}
                    if cells is None or row["v_cell"] in cells:
                        near[row["v_dim"]].see(np.frombuffer(row["v_ids"], np.int64), _matrix(row["v_data"], row["v_dim"]), cells and cells[row["v_cell"]])
            for x in near.values():
                yield from x.found([query_id, id_, "similarity"])

        return _ranked(stored.select("v_dim", "v_cell", "v_ids", "v_data").mapInArrow(find, f"{query_id} long, {id_} long, similarity double"), k, query_id, id_)

    def _cells_of(self, asked: dict[int, tuple[np.ndarray, np.ndarray]] | None, probes: int) -> dict[int, tuple] | None:
        """Queries of _sent() with the rows that look at each cell (None: every row at every cell); None where that is too much to send."""
        out = {}
        for dim, (measured, centroids) in self._known().items() if asked is not None else ():
            if dim not in asked:
                continue
            ids, data = asked[dim]
            n = min(probes or measured, len(centroids))
            if n == len(centroids):
                out[dim] = ids, data, None
                continue
            if len(ids) * n * 8 > SENT:
                return None
            near = np.concatenate([np.argpartition(-(data[a : a + 1024] @ centroids.T), n - 1, axis=1)[:, :n] for a in range(0, len(ids), 1024)])
            cell, row = near.reshape(-1), np.repeat(np.arange(len(ids)), n)
            order = np.argsort(cell, kind="stable")
            found, at = np.unique(cell[order], return_index=True)
            out[dim] = ids, data, dict(zip(found.tolist(), np.split(row[order], at[1:])))
        return None if asked is None else out
