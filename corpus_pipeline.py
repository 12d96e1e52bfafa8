"""Five stages from raw documents to packed sequences, each calling one training-data operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, with n_chars brought up to date where texts change.

Cases: an empty table goes through as one; rows sharing an identifier are judged, cut, compared and masked each by their own
text; repeated rows stay or go together; very long texts are handled whole; extra columns come through unchanged, whatever
their names, up to packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import lines, neardup, packing, pii, quality
from skein.llm.common import carrying, staged, table, unstage


def resized(docs: DataFrame, work) -> DataFrame:
    """The columns of `docs`, with the text that `work` gives it and n_chars of that text."""
    out = carrying(docs, lambda own: work(own).select(*own.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go. Null and empty texts are rejected."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents stay in the last one only. Null identifiers are never the last."""
    return resized(docs, lines.dedup_lines)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest identifier; null identifiers stay."""
    return neardup.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are masked."""
    return resized(docs, pii.mask)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", packing_stage),
]

#: The first stage's rules are learned and the third's signatures hashed, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table is deleted once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        unstage(docs)
        docs = after
    return docs
