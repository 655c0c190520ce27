"""Exact dedup as a stateful stream.

A stream over the digests of the documents keeps, per digest of the normalised text, the
stable identifier and the content locator (file and place in it) of the row that stays, and
how many rows had it. That state is kept on disk (RocksDB) without a watermark, so nothing
expires; given a folder, it outlives the run, and the next run's documents meet it. Equal
digests are added up in each task before they reach the state, so a digest that a third of
all rows share is one record a task.

Digests that were hit have the full bytes of their texts checked: the texts of this run's
rows are found by their locators and gathered per digest as a set (again within each task
first), and so is the text that an earlier run's locator names. A set of two is a collision,
and the query then fails rather than merge different texts.

Normalised: every character of [\\x20\\x09-\\x0D] deleted. Of equal texts one row stays: the
one with the most code points, then with the smallest doc_id (any doc_id before a null one),
then the first by file and place. Null counts as empty, so null, empty and blank texts are
one group. Repeated rows (equal doc_id too) count each, and one of them stays at most; rows of
one doc_id with different texts are of different groups, and none goes for the other. An empty
table gives no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import located, picked, scratch, shared_dir, without

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def digests(placed: DataFrame, names: list[str]) -> DataFrame:
    """file, row, path, doc_id, digest and n_cp of every row. placed, names: of located(docs, path=True)."""
    where = [F.col(n).alias(x) for n, x in zip(names, ("file", "row", "path"))]
    return placed.select(*where, F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normal(F.col("text")), 256).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"))


def kept_state(at: str, schema: T.StructType, spark, trigger_files: int = 1000) -> DataFrame:
    """Run the stream over the digests in folders of {at}/digests that it hasn't seen, and return its state: digest, group_size, keep_id, file, row and path, one row per digest."""
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    try:
        for k, v in _ROCKSDB.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", trigger_files).parquet(f"{at}/digests/*")
        order = F.struct((-F.col("n_cp")).alias("minus_cp"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "path", "row", "file")
        state = rows.groupBy("digest").agg(F.min(order).alias("stays"), F.count("*").alias("group_size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

        state.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    some = out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(out)
    batches = spark.read.schema(state.schema).parquet(f"{at}/out/batch=*") if some else spark.createDataFrame([], state.schema)
    # a digest that grew in a later batch was written again: its largest count is its last
    last = batches.groupBy("digest").agg(F.max(F.struct("group_size", "stays")).alias("s"))
    return last.select("digest", "s.group_size", F.col("s.stays.doc_id").alias("keep_id"), *[F.col(f"s.stays.{c}").alias(c) for c in ("file", "row", "path")])


def _judged(docs: DataFrame, state: str | None) -> tuple[DataFrame, list[str], DataFrame]:
    """docs of located(), the names of its places, and file, row, doc_id, digest, keep_id, group_size and kept of every row."""
    spark = docs.sparkSession
    shared_dir(spark)
    at = state or scratch(spark, "dedup-state")
    placed, names = located(docs, path=True)
    narrow = digests(placed, names)
    folder = f"{at}/digests/{uuid.uuid4().hex}"
    narrow.write.parquet(folder)
    narrow = spark.read.schema(narrow.schema).parquet(folder)
    known = kept_state(at, narrow.schema, spark)
    checked = checked_groups(placed, names, narrow, known, earlier=state is not None)
    rows = narrow.join(checked.select("digest", "keep_id", "group_size", F.col("file").alias("keep_file"), F.col("row").alias("keep_row")), "digest")
    # group_size is a checked one, so nothing is kept or dropped unchecked
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")) & (F.col("group_size") > 0)
    return placed, names, rows.select("file", "row", "doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def checked_groups(placed: DataFrame, names: list[str], narrow: DataFrame, state: DataFrame, earlier: bool = False) -> DataFrame:
    """state, with the bytes of the texts behind every digest that was hit compared: more than one text stops the query. earlier: it has digests of other runs, too."""
    hit = state.where("group_size > 1")
    places = narrow.join(hit.select("digest"), "digest", "left_semi").select("file", "row")
    texts = picked(placed.select("text", *names[:2]), [F.col(n) for n in names[:2]], places, [F.col("file"), F.col("row")]).select(normal(F.col("text")).alias("t"))
    if earlier:
        elsewhere = hit.join(narrow.select("path").distinct(), "path", "left_anti").join(narrow.select("digest").distinct(), "digest", "left_semi").select("path", "row")
        files = [r[0] for r in elsewhere.select("path").distinct().collect()]  # names of files of earlier runs
        if files:
            stored, own = located(placed.sparkSession.read.parquet(*files), path=True)
            found = stored.join(elsewhere, (F.col(own[2]) == F.col("path")) & (F.col(own[1]) == F.col("row")), "left_semi")
            texts = texts.unionByName(found.select(normal(F.col("text")).alias("t")))
    sets = texts.select(F.sha2("t", 256).alias("digest"), "t").groupBy("digest").agg(F.size(F.collect_set("t")).alias("n_texts"))
    joined = state.join(sets, "digest", "left")
    fine = F.when(F.col("n_texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint")).otherwise(F.col("group_size"))
    return joined.withColumn("group_size", fine).drop("n_texts")


def dedup(docs: DataFrame, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    state: a folder that all executors share, in which the digests of this run stay for the next; one run at a time may use it. group_size and keep_id are over all runs so far, kept is
    false where an earlier run's row stays, and the files of earlier runs must still be there for their bytes to be compared.
    """
    return _judged(docs, state)[2].select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def unique(docs: DataFrame, state: str | None = None) -> DataFrame:
    """The rows of docs that stay: one of each group of equal texts."""
    placed, names, found = _judged(docs, state)
    return without(placed, names, found.where("NOT kept").select("file", "row"))


def op7(docs: DataFrame) -> DataFrame:
    return dedup(docs)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t, length(coalesce(text, '')) AS n_cp FROM documents)
SELECT doc_id, CAST(first_value(doc_id) OVER w AS BIGINT) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY n_cp DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
