"""Small helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a folder of this machine, if the session has no other machine (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lorespring-")
            atexit.register(shutil.rmtree, _own[app], True)
        found = "file://" + _own[app]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: lineage ends there and nothing is computed twice."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df._written_at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of an Arrow batch: texts are long, and a batch is whole in the memory of the JVM and of Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch from Spark's default, which suits short rows, and let Python workers give large arrays back to the system.

    Unions don't claim their inputs' partitioning: Spark 4.1 can't zip such a one with a join's other side once AQE has changed one of them.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if (here := str(Path(__file__).resolve().parents[2])) not in paths:  # workers import this package, too
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [here, *paths]))
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "4194304"), ("MALLOC_TRIM_THRESHOLD_", "4194304"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        spark.sparkContext.environment.setdefault(name, value)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextlib.contextmanager
def roomy_heap(spark: SparkSession) -> Iterator[None]:
    """Let Python workers of what is planned inside keep up to 32 MB that they have freed. Arrays of some MB, made and freed all the time, otherwise cost more in pages that are given back and asked for again than in what is done with them."""
    environment = spark.sparkContext.environment
    before = dict(environment)
    environment["MALLOC_TRIM_THRESHOLD_"] = str(32 << 20)
    try:
        yield
    finally:
        environment.clear()
        environment |= before


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)


def tasks_for(spark: SparkSession, n_bytes: int, each: int = 32 << 20) -> int:
    """How many tasks a shuffle of so many bytes takes: as many as the session says, more where a task would get more than `each`."""
    return max(partitions(spark), -(-n_bytes // each))


#: Nodes of a plan under which a row is still one row of one file.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias"}


def _of_files(docs: DataFrame) -> bool:
    node = docs._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in _ROW_BY_ROW:
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def located(docs: DataFrame, path: bool = False) -> tuple[DataFrame, list[str]]:
    """docs with two columns that tell rows apart, whatever is in them, and the columns' names: a hash of the row's file (64 bits, so files share one with a chance of files**2 / 2**65) and its place there. path: the file's name itself comes third.

    Rows of files have such a place already. Any other frame is written to the shared folder first.
    """
    if not _of_files(docs):
        docs = written(docs, "rows")
    names: list[str] = []
    for name in ("__file", "__row", "__path"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    meta = docs.metadataColumn("_metadata")
    where = [F.xxhash64(meta.getField("file_path")), meta.getField("row_index"), meta.getField("file_path")]
    n = 3 if path else 2
    return docs.select("*", *[c.alias(x) for c, x in zip(where[:n], names)]), names[:n]


#: Bits of the bitmap by which rows are picked before a shuffle: 8 MB are broadcast, however large the tables.
PICK_BITS = 1 << 26


def mark(df: DataFrame, of: list[Column], chosen: DataFrame, key: list[Column], name: str = "__may") -> DataFrame:
    """df with a column more: whether the bitmap of the keys of `chosen` has the bit of `of`."""
    place = lambda c: F.pmod(F.xxhash64(*c), F.lit(PICK_BITS))
    word = F.lit(1 << 15)
    bits = chosen.select(place(key).alias("h")).select(F.floor(F.col("h") / word).alias("__part"), (F.col("h") % word).alias("at")).groupBy("__part").agg(F.bitmap_construct_agg("at").alias("__bits"))
    # 2048 rows of 4 KB
    found = df.withColumn("__h", place(of)).withColumn("__part", F.floor(F.col("__h") / word)).join(F.broadcast(bits), "__part", "left")
    byte = F.expr("cast(conv(hex(substring(__bits, cast((__h % 32768) div 8 + 1 as int), 1)), 16, 10) as int)")
    bit = F.call_function("shiftright", byte, F.expr("cast(__h % 8 as int)")).bitwiseAND(F.lit(1))
    return found.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__h", "__part", "__bits")


def picked(df: DataFrame, of: Column | list[Column], chosen: DataFrame, key: Column | list[Column]) -> DataFrame:
    """Rows of df whose `of` may be among the keys of `chosen`. None that is among them goes missing; of the others about one in PICK_BITS / keys stays."""
    many = lambda c: c if isinstance(c, list) else [c]
    return mark(df, many(of), chosen, many(key)).where("__may").drop("__may")


def without(docs: DataFrame, names: list[str], gone: DataFrame) -> DataFrame:
    """Rows of docs, of located(), whose place isn't in gone (file, row); without the columns `names` that tell the place. Only rows that the bitmap can't clear are shuffled."""
    columns = [c for c in docs.columns if c not in names]
    kept = [F.col(f"`{c}`") for c in columns]
    marked = mark(docs, [F.col(n) for n in names[:2]], gone, [F.col("file"), F.col("row")])
    file, row = (F.col(n) for n in names[:2])
    hit = gone.select(F.col("file").alias("__gone_file"), F.col("row").alias("__gone_row")).hint("merge")  # in the same way at every size
    unsure = marked.where("__may").join(hit, (file == F.col("__gone_file")) & (row == F.col("__gone_row")), "left_anti")
    return marked.where("NOT __may").select(*kept).unionByName(unsure.select(*kept))
