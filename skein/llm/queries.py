"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, licenses, lines, neardup, packing, pii, quality, sstable, suffixes
from .common import table


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.written_and_read(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_line_dedup": lines.query,
        "op3_embedding_near_dedup": embeddings.query,
        "op4_pii": pii.query,
        "op5_license_scans": licenses.query,
        "op6_token_id_output": op6,
        "op7_minhash_near_dedup": neardup.query,
        "op8_bpe_round_trip": op8,
        "op9_quality_rules": quality.query,
        "op10_suffix_array_dedup": suffixes.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.ORACLE, "op5_license_scans": licenses.oracle()}
