"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import delete, scratch


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node that links reach from each node that has an edge.

    A step moves every link of a node to the smallest of its neighbours, first for larger
    neighbours, then for smaller ones; it is an aggregation and a join on the node, so no
    task holds a component. The number of steps grows with the logarithm of a component's
    diameter. Loops and repeated edges are allowed; null ends are dropped.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "edges"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = kept(small.where("u <> v").distinct())
        for path in paths[:-1]:
            delete(spark, path)
        del paths[:-1]
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots)
