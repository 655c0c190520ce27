"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, license_scan, mixing, packing, parity_join, quality, sharding, stream_dedup, suffix_dedup, unit_dedup
from ._spark import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _over_documents(langid.op1),
        "op2_ngram_jaccard_join": _over_documents(parity_join.op2),
        "op3_quality_rules": lambda spark, sf_dir: quality.op3(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
        "op4_source_mixing": _over_documents(mixing.op4),
        "op5_suffix_array_dedup": _over_documents(suffix_dedup.op5),
        "op6_line_dedup": _over_documents(unit_dedup.op6),
        "op7_exact_dedup": _over_documents(stream_dedup.op7),
        "op8_best_fit_packing": _over_documents(packing.op8),
        "op9_license_scan": _over_documents(license_scan.op9),
        "op10_sharding": _over_documents(sharding.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": parity_join.SQL, "op5_suffix_array_dedup": suffix_dedup.SQL, "op6_line_dedup": unit_dedup.SQL, "op7_exact_dedup": stream_dedup.SQL}
