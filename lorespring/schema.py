"""Schemas of the stored tables and of what operators return."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), True)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DOCS = _struct(id=T.LongType(), content=T.StringType(), content_hash=T.StringType(), embedding=VECTOR)
SOURCES = _struct(id=T.LongType(), content=T.StringType(), content_hash=T.StringType(), metadata=T.StringType(), created_at=T.TimestampType())
CHUNKS = _struct(id=T.LongType(), source_id=T.LongType(), chunk_index=T.IntegerType(), content=T.StringType(), start_pos=T.IntegerType(), end_pos=T.IntegerType(), embedding=VECTOR)
CHUNK_HIT = _struct(chunk_id=T.LongType(), source_id=T.LongType(), chunk_index=T.IntegerType(), content=T.StringType(), similarity=T.DoubleType())
HYBRID_HIT = _struct(doc_id=T.LongType(), content=T.StringType(), score=T.DoubleType(), vector_rank=T.IntegerType(), bm25_rank=T.IntegerType())
