"""Sharding: a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of
their key. The records of a bucket that gets far more than its part, as one key has that many,
are scattered over all buckets by what else tells them apart (columns, then a number among equal
ones, so that reruns agree). Pass 2 sorts each
bucket by its key (so that reruns agree), shuffles it by Fisher-Yates with a generator
seeded by the bucket, and gives every record its place in the whole order: the records of
the buckets before it, plus its place in its own. The order is cut into shards whose counts
differ by one at most (law `rows`), so a bucket is of one shard or of two neighbours, and is
written as it is. One shuffle moves the records; the counts need only the key column and the
payloads' sizes, and stay in tables.

Cases: null keys and payloads are records like any other; records with equal keys are
ordered by a hash of all their columns, and wholly equal ones are interchangeable. Equal
texts (also a third of all records) are spread over the shards like other records: under the
law `rows` no shard has room for such a group. An empty table gives no rows; a very long text
only makes its bucket larger. Columns of df named shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ._spark import located, scratch, written

SHARDS = 40
BUCKET_BYTES = 16 << 20
#: Bytes that a record takes besides its payload; how many times its part a bucket may hold unsplit; rows of a table that is broadcast.
RECORD_BYTES, UNEVEN, BROADCAST_ROWS = 64, 3, 1 << 17


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of 0..n-1 by Fisher and Yates's exchanges, which Generator.permutation makes in compiled code."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def _before(counts: DataFrame) -> DataFrame:
    """counts (b, n) with `before`, the n of all smaller b: sums within slices of b, and of the slices."""
    sliced = counts.withColumn("slice", F.expr("b div 4096"))
    upto = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    slices = sliced.groupBy("slice").agg(F.sum("n").alias("n")).select("slice", upto(W.Window.orderBy("slice"), "n").alias("__base"))
    return sliced.join(slices, "slice").select("b", "n", (F.col("__base") + upto(W.Window.partitionBy("slice").orderBy("b"), "n")).alias("before"))


def _copies(df: DataFrame, place: list[str]) -> DataFrame | None:
    """Place and `__copy`, from 0 on among wholly equal records, of the records of df that have an equal one; None if there are none. A place is another one in each run, so it only tells equal records apart."""
    many = written(df.groupBy("__tie").agg(F.count("*").alias("n")).where("n > 1").select("__tie"), "ties")
    if many.isEmpty():
        return None
    of = df.join(many, "__tie", "left_semi").select("__tie", *place, F.pmod(F.xxhash64(*place), F.lit(1024)).alias("slice"))
    slices = of.groupBy("__tie", "slice").agg(F.count("*").alias("n"))
    before = slices.select("__tie", "slice", F.coalesce(F.sum("n").over(W.Window.partitionBy("__tie").orderBy("slice").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.row_number().over(W.Window.partitionBy("__tie", "slice").orderBy(*place)) - 1
    return written(of.withColumn("here", here).join(before, ["__tie", "slice"]).select(*place, (F.col("before") + F.col("here")).alias("__copy")), "copies")


def external_shuffle(df: DataFrame, key: str, payload_bytes: str | None = None, seed: int = 7, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with int `shard` and long `slot`. payload_bytes: an SQL expression for the bytes of a record's long columns, if it carries any."""
    df = df.drop("shard", "slot")
    columns, fields = df.columns, df.schema.fields
    size = (F.lit(RECORD_BYTES) + (F.coalesce(F.expr(payload_bytes), F.lit(0)) if payload_bytes else F.lit(0))).cast("long")
    total, rows = df.agg(F.sum(size), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    scatter = lambda d: d.withColumns({"__bucket": F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)), "__key": F.col(key), "__tie": F.xxhash64(*[F.col(f"`{c}`") for c in columns])})
    scattered = scatter(df)
    sizes = written(scattered.groupBy("__bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "buckets")
    over = sizes.where((F.col("bytes") > UNEVEN * bucket_bytes) & (F.col("n") > 1)).select(F.col("__bucket").alias("__over"))
    if not over.isEmpty():
        df, place = located(df)
        scattered = scatter(df)
        n_over = over.count()
        over = F.broadcast(over) if n_over <= BROADCAST_ROWS else over
        copies = _copies(scattered.join(over, scattered["__bucket"] == over["__over"]), place)
        scattered = scattered.join(over, scattered["__bucket"] == over["__over"], "left")
        if copies is None:
            scattered = scattered.withColumn("__copy", F.lit(0).cast("long"))
        else:  # only records of such buckets are joined
            rest = scattered.where(F.col("__over").isNull()).withColumn("__copy", F.lit(0).cast("long"))
            scattered = rest.unionByName(scattered.where(F.col("__over").isNotNull()).join(copies, place, "left"))
        again = F.pmod(F.xxhash64(F.lit(seed + 1), "__tie", F.coalesce("__copy", F.lit(0).cast("long"))), F.lit(buckets))
        scattered = scattered.withColumn("__bucket", F.when(F.col("__over").isNull(), F.col("__bucket")).otherwise(again)).drop("__over", "__copy", *place)
        sizes = written(scattered.groupBy("__bucket").agg(F.count("*").alias("n")), "buckets")
    before = written(_before(sizes.select(F.col("__bucket").alias("b"), "n")), "before")
    each, longer = divmod(rows, shards)

    def shuffle(group: pa.Table) -> pa.Table:
        b, first = group.column("__bucket")[0].as_py(), group.column("__before")[0].as_py()
        ranks = pc.sort_indices(group, sort_keys=[("__key", "ascending"), ("__tie", "ascending")]).to_numpy()
        places = np.empty(group.num_rows, np.int64)
        places[ranks] = fisher_yates(group.num_rows, (seed, b))
        places += first
        # the first `longer` shards have a record more
        shard = np.where(places < longer * (each + 1), places // (each + 1), longer + (places - longer * (each + 1)) // max(each, 1))
        slot = places - shard * each - np.minimum(shard, longer)
        return group.select(columns).append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    known = before.select(F.col("b").alias("__b"), F.col("before").alias("__before"))
    joined = scattered.join(F.broadcast(known) if buckets <= BROADCAST_ROWS else known, scattered["__bucket"] == known["__b"]).drop("__b")
    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return joined.groupBy("__bucket").applyInArrow(shuffle, schema)


def write_shards(df: DataFrame, path: str, key: str, payload_bytes: str | None = None, **settings) -> None:
    """Write the shuffled records as one folder per shard, each file holding slots in order. Buckets are written where they were shuffled."""
    placed = external_shuffle(df, key, payload_bytes, **settings)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def op10(docs: DataFrame) -> DataFrame:
    """The place of every document in 40 shards, under the law `rows`, with the size and checksum of the text that was written there."""
    spark, records = docs.sparkSession, docs.select("doc_id", "text")
    path = scratch(spark, "shards")
    write_shards(records, path, "doc_id", "octet_length(text)", bucket_bytes=BUCKET_BYTES)
    placed = spark.read.schema(T.StructType([*records.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
