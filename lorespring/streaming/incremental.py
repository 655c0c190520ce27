"""Vectors that arrive while an index stands: a delta beside the main table.

A stream appends what arrives to the delta, one folder per micro-batch, so a batch that
is run again overwrites itself. Searches rank both and keep an id's nearest copy, the
delta's on a tie. From THRESHOLD rows on, or a RATIO of
the main table's where that is more, the delta is due to be merged: so each row is rewritten
about 1 / RATIO times for each doubling of the table, not once a micro-batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..operators import knn
from ..schema import VECTOR

THRESHOLD, RATIO = 100, 0.1
ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", VECTOR)])


def search(queries: DataFrame, main: DataFrame, delta: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, source, rank) over main and delta (id, embedding); source is 'main' or 'delta'."""
    from_main = knn.top_k(queries, main, 2 * k, id_="id").withColumn("source", F.lit("main"))
    from_delta = knn.top_k(queries, delta, 2 * k, id_="id").withColumn("source", F.lit("delta"))
    both = from_main.unionByName(from_delta).withColumn("distance", F.round(1 - F.col("similarity"), 6))
    one = W.Window.partitionBy("query_id", "id").orderBy("distance", "source")
    best = both.withColumn("__r", F.row_number().over(one)).where("__r = 1")
    order = W.Window.partitionBy("query_id").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "distance", "source", "rank")


def stats(delta: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row: buffer_size, threshold, needs_merge."""
    return delta.agg(F.count("*").alias("buffer_size")).select("buffer_size", F.lit(threshold).cast("long").alias("threshold"), (F.col("buffer_size") >= threshold).alias("needs_merge"))


@dataclass
class DeltaIndex:
    """Main and delta tables in a folder that all executors share. A folder of the main table is never changed: a merge writes the next one and then names it."""

    spark: SparkSession
    path: str

    def _parts(self, name: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(x.getPath()) for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))

    def _rows(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*parts) if parts else self.spark.createDataFrame([], ROWS)

    def _main(self) -> str | None:
        versions = [p for p in self._parts("main")]
        return versions[-1] if versions else None

    def _merged(self) -> set[str]:
        """Names of the batches that the main table has."""
        main = self._main()
        return {r[0] for r in self.spark.read.text(main.replace("/main/", "/merged/")).collect()} if main else set()

    def main(self) -> DataFrame:
        return self._rows([m] if (m := self._main()) else []).join(self.removed(), "id", "left_anti")

    def delta(self) -> DataFrame:
        have = self._merged()
        return self._rows([p for p in self._parts("delta") if p.rsplit("/", 1)[1] not in have]).join(self.removed(), "id", "left_anti")

    def removed(self) -> DataFrame:
        return self._rows(self._parts("removed")).select("id").distinct()

    def add(self, rows: DataFrame, name: str) -> None:
        """Append rows (id, embedding) under a name; the same name again replaces them."""
        rows.select(*[F.col(f.name).cast(f.dataType) for f in ROWS]).write.mode("overwrite").parquet(f"{self.path}/delta/{name}")

    def remove(self, ids: DataFrame, name: str) -> None:
        ids.select(F.col("id").cast("long"), F.lit(None).cast(VECTOR).alias("embedding")).write.mode("overwrite").parquet(f"{self.path}/removed/{name}")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Start appending a stream (id, embedding); merges when the delta is due."""

        def take(batch: DataFrame, number: int) -> None:
            self.add(batch, f"batch-{number:09d}")
            due = max(THRESHOLD, int(RATIO * self.main().count()))
            if stats(self.delta(), due).first()["needs_merge"]:
                self.merge()

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def merge(self) -> None:
        """The next main table: the old one and the delta, of an id the delta's row."""
        parts = [p.rsplit("/", 1)[1] for p in self._parts("delta")]
        new, old = self.delta(), self.main()
        n = len(self._parts("main"))
        merged = self._merged() | set(parts)
        self.spark.createDataFrame([(p,) for p in sorted(merged)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/merged/{n:06d}")
        rows = old.join(new.select("id"), "id", "left_anti").unionByName(new)
        rows.write.mode("overwrite").parquet(f"{self.path}/main/{n:06d}")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search(queries, self.main(), self.delta(), k)
