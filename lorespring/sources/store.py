"""The document stores as Parquet folders: ingest with deduplication, lookups, deletion.

A store is a folder with the tables `sources` and `chunks` (or `docs`). Ids go on from the
largest one there. Appends are one commit each; deletions are tombstones that reads leave
out, until compact() rewrites the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .. import schema
from ..functions.text import content_hash


def with_hash(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs with content_hash; one that is there is kept where it isn't null (the migration of old tables)."""
    hashed = content_hash(F.col(text))
    return docs.withColumn("content_hash", F.coalesce(F.col("content_hash"), hashed) if "content_hash" in docs.columns else hashed)


def deduplicated(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, content_hash, source_id (the first id with the same text) and is_duplicate of each row. Texts are hashed before anything is shuffled; null texts are one group."""
    hashed = docs.select(F.col(id_), content_hash(F.coalesce(F.col(text), F.lit(""))).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(id_).alias("source_id"))
    return hashed.join(first, "content_hash").select(id_, "content_hash", "source_id", (F.col(id_) != F.col("source_id")).alias("is_duplicate"))


def unseen(incoming: DataFrame, stored: DataFrame, incoming_text: str = "text", stored_text: str = "text") -> DataFrame:
    """(content_hash, content) of the different texts of incoming that stored doesn't have."""
    new = incoming.where(F.col(incoming_text).isNotNull()).select(content_hash(F.col(incoming_text)).alias("content_hash"), F.col(incoming_text).alias("content")).dropDuplicates(["content_hash"])
    return new.join(stored.select(content_hash(F.col(stored_text)).alias("content_hash")), "content_hash", "left_anti")


def lines(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(source_id, chunk_index, content): the lines of each text as chunks, blank ones left out, numbered as they come."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    return docs.select(F.col(id_).alias("source_id"), F.posexplode(parts).alias("chunk_index", "content"))


def in_range(chunks: DataFrame, low: int, high: int) -> DataFrame:
    """Chunks with low <= chunk_index <= high, similarity 0."""
    return chunks.where(F.col("chunk_index").between(low, high)).withColumn("similarity", F.lit(0.0))


def without_sources(chunks: DataFrame, gone: DataFrame, id_: str = "source_id") -> DataFrame:
    return chunks.join(gone.select(F.col(id_)), id_, "left_anti")


@dataclass
class SourceStore:
    """`sources` and `chunks` in a folder that all executors share."""

    spark: SparkSession
    path: str

    def init(self) -> SourceStore:
        for name, kind in self._tables().items():
            self.spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{self.path}/{name}")
        return self

    @staticmethod
    def _tables() -> dict[str, T.StructType]:
        return {"sources": schema.SOURCES, "chunks": schema.CHUNKS, "deleted": T.StructType([T.StructField("source_id", T.LongType())])}

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.schema(self._tables()[name]).parquet(f"{self.path}/{name}")
        if name == "deleted":
            return table
        gone = self.read("deleted").distinct()
        return table.join(gone.withColumnRenamed("source_id", "id") if name == "sources" else gone, "id" if name == "sources" else "source_id", "left_anti")

    def add_sources(self, incoming: DataFrame) -> DataFrame:
        """incoming (content, metadata) -> (content_hash, source_id, is_duplicate), one row per different text; new ones are appended."""
        new = with_hash(incoming.where(F.col("content").isNotNull())).dropDuplicates(["content_hash"])
        have = self.read("sources").select("content_hash", F.col("id").alias("have_id"))
        joined = new.join(have, "content_hash", "left")
        base = self.spark.read.schema(schema.SOURCES).parquet(f"{self.path}/sources").agg(F.max("id")).first()[0] or 0
        fresh = joined.where("have_id IS NULL")
        numbered = _numbered(fresh, base, "content_hash")
        rows = numbered.select("id", "content", "content_hash", F.col("metadata") if "metadata" in incoming.columns else F.lit(None).cast("string").alias("metadata"), F.current_timestamp().alias("created_at"))
        rows.write.mode("append").parquet(f"{self.path}/sources")
        now = self.read("sources").select("content_hash", F.col("id").alias("source_id"))
        return new.select("content_hash").join(now, "content_hash").select("content_hash", "source_id", (F.col("source_id") <= base).alias("is_duplicate"))

    def add_chunks(self, chunks: DataFrame) -> int:
        """Append chunks (source_id, chunk_index, content, start_pos, end_pos, embedding) in one commit; how many there were."""
        base = self.spark.read.schema(schema.CHUNKS).parquet(f"{self.path}/chunks").agg(F.max("id")).first()[0] or 0
        rows = _numbered(chunks, base, "source_id", "chunk_index").select(*[F.col(f.name).cast(f.dataType) for f in schema.CHUNKS])
        before = self.spark.read.schema(schema.CHUNKS).parquet(f"{self.path}/chunks").count()
        rows.write.mode("append").parquet(f"{self.path}/chunks")
        return self.spark.read.schema(schema.CHUNKS).parquet(f"{self.path}/chunks").count() - before

    def source(self, source_id: int) -> DataFrame:
        return self.read("sources").where(F.col("id") == source_id).select("content")

    def source_chunks(self, source_id: int) -> DataFrame:
        return self.read("chunks").where(F.col("source_id") == source_id).orderBy("chunk_index").select("content")

    def adjacent_chunks(self, source_id: int, low: int, high: int) -> DataFrame:
        return in_range(self.read("chunks").where(F.col("source_id") == source_id), low, high).orderBy("chunk_index")

    def delete(self, source_ids: DataFrame) -> None:
        """Tombstones for the sources (source_id) and their chunks."""
        source_ids.select(F.col("source_id").cast("long")).write.mode("append").parquet(f"{self.path}/deleted")

    def clear(self) -> None:
        for name, kind in self._tables().items():
            self.spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def compact(self, to: str) -> SourceStore:
        """The live rows in a new folder."""
        other = SourceStore(self.spark, to)
        for name in ("sources", "chunks"):
            self.read(name).write.mode("overwrite").parquet(f"{to}/{name}")
        return other.init()

    def stats(self) -> DataFrame:
        """One row: source_count and chunk_count."""
        return self.read("sources").agg(F.count("*").alias("source_count")).crossJoin(self.read("chunks").agg(F.count("*").alias("chunk_count")))


@dataclass
class FlatStore:
    """`docs` (id, content, content_hash, embedding) in a folder that all executors share: documents that are searched whole."""

    spark: SparkSession
    path: str

    def init(self) -> FlatStore:
        self.spark.createDataFrame([], schema.DOCS).write.mode("ignore").parquet(f"{self.path}/docs")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(schema.DOCS).parquet(f"{self.path}/docs")

    def add_documents(self, incoming: DataFrame) -> DataFrame:
        """incoming (content, embedding) -> (content_hash, id, is_duplicate) of each different text; new ones are appended. A null or empty embedding stops it before anything is written."""
        usable = incoming.where(F.col("content").isNotNull())
        if not usable.where(F.coalesce(F.size("embedding"), F.lit(-1)) <= 0).isEmpty():
            raise ValueError("a document has no embedding")
        return self._append(with_hash(usable).dropDuplicates(["content_hash"]), known=True)

    def add_simple(self, incoming: DataFrame) -> None:
        """Append (content, embedding) as they are, without a hash and without looking for duplicates; migrate() hashes them later."""
        self._append(incoming.withColumn("content_hash", F.lit(None).cast("string")), known=False)

    def _append(self, rows: DataFrame, known: bool) -> DataFrame:
        base = self.read().agg(F.max("id")).first()[0] or 0
        fresh = rows.join(self.read().select("content_hash").where("content_hash IS NOT NULL"), "content_hash", "left_anti") if known else rows
        numbered = _numbered(fresh, base, *(["content_hash"] if known else ["content"]))
        numbered.select(*[F.col(f.name).cast(f.dataType) for f in schema.DOCS]).write.mode("append").parquet(f"{self.path}/docs")
        now = self.read().select("content_hash", "id")
        return rows.select("content_hash").join(now, "content_hash").select("content_hash", "id", (F.col("id") <= base).alias("is_duplicate"))

    def migrate(self, to: str) -> FlatStore:
        """The documents in a new folder, all with a hash; of equal texts the smallest id's stays."""
        rows = with_hash(self.read())
        first = rows.groupBy("content_hash").agg(F.min("id").alias("id"))
        rows.join(first, ["content_hash", "id"], "left_semi").select(*[f.name for f in schema.DOCS]).write.mode("overwrite").parquet(f"{to}/docs")
        return FlatStore(self.spark, to)

    def count(self) -> int:
        return self.read().count()

    def drop(self) -> None:
        """Remove the folder."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _numbered(rows: DataFrame, base: int, *order: str) -> DataFrame:
    """rows with ids base + 1, base + 2 ... without gathering them: ranges of the order are numbered by partition, from counts per partition."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.coalesce(F.sum("__n").over(W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn("id", F.lit(base) + 1 + F.col("__before") + F.col("__in")).drop("__at", "__part", "__in", "__before")
