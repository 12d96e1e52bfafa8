"""Checks that an index's tables agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import TIERS, Index


def counts(index: Index) -> DataFrame:
    """name, n: rows of each table, and chunks covered by each field."""
    one = lambda name, df, n=F.count("*"): df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    out = one("documents", index.documents).unionByName(one("chunks", index.chunks))
    out = out.unionByName(index.lengths.groupBy("field").agg(F.count("*").alias("n")).select(F.concat(F.lit("lengths_"), "field").alias("name"), "n"))
    return out.unionByName(one("postings", index.by_field(), F.coalesce(F.sum(F.size(F.array_distinct("terms"))), F.lit(0)).cast("long")))


def issues(index: Index) -> DataFrame:
    """rule, n for every rule that something breaks; no rows for a healthy index. What tables say of a document and of a
    chunk is added up in one pass each, whose rows are identifiers and counts."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bare = [f"{f}_bare" for f in TIERS]  # a length without its terms
    added = lambda df, key: df.groupBy(key).agg(*[F.sum(c).alias(c) for c in df.columns if c != key])
    of = lambda rows, condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col(rows))), none)
    by_document = added(index.documents.select("doc_id", one.alias("listed"), none.alias("here")).unionByName(index.chunks.select("doc_id", none.alias("listed"), one.alias("here"))), "doc_id")
    found = [by_document.agg(of("here", "listed = 0").alias("orphan_chunks"), of("listed", "here = 0").alias("documents_without_chunks"))]
    covered = index.terms.select("chunk_id", none.alias("here"), *[F.col(f"{f}_length").isNotNull().cast("long").alias(f) for f in TIERS], *[(~F.col(f"{f}_length").eqNullSafe(F.size(f))).cast("long").alias(f"{f}_bare") for f in TIERS])
    by_chunk = index.chunks.select("chunk_id", one.alias("here"), *[none.alias(c) for c in (*TIERS, *bare)]).unionByName(covered)
    rules = {f"{f}_{rule}": n for f in TIERS for rule, n in (("missing", of("here", f"{f} = 0")), ("extra", of(f, "here = 0")), ("unposted", of(f"{f}_bare", "true")))}
    found.append(added(by_chunk, "chunk_id").agg(*[n.alias(rule) for rule, n in rules.items()]))
    rows = [df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in df.columns]))) for df in found]
    return rows[0].unionByName(rows[1]).where("n > 0")


def listed(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their numbers of chunks, by path."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return documents.join(n, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy("path")
