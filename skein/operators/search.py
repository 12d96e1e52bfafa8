"""Ranked keyword search, for one query or many at once.

Tier 1 asks the token index for all of a query's tokens, tier 2 the raw index for all of its terms, and tier 3, for
queries with CJK characters, scans contents. A query's results come from its first tier that has any after filters.
Scores are negated BM25 with statistics of the whole index, so lower is better; ties go by path and place. Hits are ranked
without their contents, which only the top ones are joined with.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .postings import TIERS, Index

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NAMED = 1_000  # terms up to which they are picked out inside a chunk's row, instead of a join with all of its terms
SENT = 100_000  # rows of queries or of top hits up to which they are sent to every task


def few(df: DataFrame, rows: int) -> DataFrame:
    """Hints that a table of so many rows can be sent to every task; one of more is joined as Spark finds best."""
    return F.broadcast(df) if rows <= SENT else df


def parsed(spark: SparkSession, queries: Mapping[int, str]) -> tuple[DataFrame, list[tuple]]:
    """The queries' terms, as a table and as its rows: query_id, field, n_terms, term_no, n_tokens, place, term. A term without tokens leaves its tier without rows."""
    rows = []
    for query_id, query in queries.items():
        words = tx.query_terms(query)
        if not words:
            raise ValueError("a query needs at least one term")
        for field, parts in (("token", tx.plain_tokens(" ".join(words))), ("raw", words)):
            cut = [tx.plain_terms(p) for p in parts]
            if all(cut):
                rows += [(query_id, field, len(cut), no, len(c), place, term) for no, c in enumerate(cut) for place, term in enumerate(c)]
    return spark.createDataFrame(rows, "query_id long, field string, n_terms int, term_no int, n_tokens int, place int, term string"), rows


def idf(n_chunks: Column, df: Column) -> Column:
    return F.greatest(F.ln((n_chunks - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def occurrences(index: Index, asked: DataFrame, rows: list[tuple]) -> DataFrame:
    """Every place of the queries' terms, a row for each query that names it."""
    own, named = index.by_field("chunk_id", "doc_id", "chunk_index"), {field: sorted({r[-1] for r in rows if r[1] == field}) for field in TIERS}
    places = F.posexplode("terms").alias("at", "term")
    if sum(map(len, named.values())) <= NAMED:
        of_field = lambda f: F.filter(F.transform("terms", lambda t, i: F.when(t.isin(named[f]), F.struct(i.alias("at"), t.alias("term")))), lambda x: x.isNotNull())
        here = {f: F.col("field") == f for f in TIERS if named[f]}
        own = own.where(reduce(or_, [is_f & F.arrays_overlap("terms", F.array(*map(F.lit, named[f]))) for f, is_f in here.items()], F.lit(False)))
        places = F.inline(F.coalesce(*[F.when(is_f, of_field(f)) for f, is_f in here.items()])) if here else places
    return own.select("field", "chunk_id", "doc_id", "chunk_index", "length", places).join(few(asked, len(rows)), ["field", "term"])


def matches(index: Index, asked: DataFrame, rows: list[tuple]) -> DataFrame:
    """query_id, field, chunk_id, doc_id, chunk_index, score of the chunks that hold all of a query's terms; phrases by
    adjacent places. asked, rows: from `parsed`."""
    place = ["chunk_id", "doc_id", "chunk_index"]
    kept, terms = ["query_id", "field", "n_terms", "term_no", *place, "length"], len(rows)
    hits = occurrences(index, asked, rows)
    occurs = hits.where("n_tokens = 1").groupBy(*kept).agg(F.count("*").alias("f"))
    if any(r[4] > 1 for r in rows):
        # a phrase starts where all of its tokens stand at their places
        starts = hits.where("n_tokens > 1").groupBy(*kept, "n_tokens", (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).where("n = n_tokens")
        occurs = occurs.unionByName(starts.groupBy(*kept).agg(F.count("*").alias("f")))
    df = occurs.groupBy("query_id", "field", "term_no").agg(F.count("*").alias("df"))  # a row for each query term
    scored = occurs.join(few(df, terms), ["query_id", "field", "term_no"]).join(F.broadcast(index.stats), "field")  # two rows
    weight = idf(F.col("n_chunks"), F.col("df")) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("term_no", weight.alias("w")))), lambda x: x["w"])  # a row for each query term
    total = F.aggregate(in_order, F.lit(0.0), lambda a, w: a + w)  # in one order, so that equal chunks score alike to the last bit
    return scored.groupBy("query_id", "field", *place, "n_terms").agg(F.count("*").alias("n"), (-total).alias("score")).where("n = n_terms").select("query_id", "field", *place, "score")


def document_filter(documents: DataFrame, file_type: str | None = None, path: str | None = None) -> DataFrame:
    """By type and by path, which is made absolute: one that is a directory here, or ends in a separator, takes the files
    below it (case as it is), any other is a file."""
    if file_type is not None:
        documents = documents.where(F.col("file_type") == file_type.lower().lstrip("."))
    if path is not None:
        own = os.path.realpath(os.path.expanduser(path))
        below = own.rstrip(os.sep) + os.sep
        documents = documents.where(F.col("path").startswith(below) if path.endswith(os.sep) or os.path.isdir(own) else F.col("path") == own)
    return documents


def scanned(index: Index, spark: SparkSession, queries: Mapping[int, str]) -> DataFrame | None:
    """Tier 3: chunks whose contents are LIKE every term, for queries with CJK characters. One scan for all of them."""
    asked = [F.when(tx.like_all(F.col("content"), query), F.lit(query_id).cast("long")) for query_id, query in queries.items() if any("一" <= c <= "鿿" for c in query)]
    if not asked:
        return None
    found = index.chunks.select("chunk_id", "doc_id", "chunk_index", F.explode(F.filter(F.array(*asked), lambda q: q.isNotNull())).alias("query_id"))
    return found.select("query_id", F.lit(3).alias("tier"), "chunk_id", "doc_id", "chunk_index", F.lit(0.0).alias("score"))


def ranked(index: Index, queries: Mapping[int, str], *, limit: int = 10, file_type: str | None = None, path: str | None = None) -> DataFrame:
    """query_id, rank, tier, chunk_id, doc_id, path, filename, file_type, chunk_index, score, best first."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    spark = index.chunks.sparkSession
    asked, rows = parsed(spark, queries)
    tier = F.when(F.col("field") == "token", TIERS["token"]).otherwise(TIERS["raw"])
    found = matches(index, asked, rows).select("query_id", tier.alias("tier"), "chunk_id", "doc_id", "chunk_index", "score")
    if (third := scanned(index, spark, queries)) is not None:
        found = found.unionByName(third)
    kept = found.join(document_filter(index.documents, file_type, path).select("doc_id", "path", "filename", "file_type"), "doc_id")
    # the best of each tier first, which a task can thin before the shuffle; then the first tier's
    best = Window.partitionBy("query_id", "tier").orderBy("score", "path", "chunk_index")
    top = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    first = F.min("tier").over(Window.partitionBy("query_id"))
    return top.withColumn("first", first).where("tier = first").select("query_id", "rank", "tier", "chunk_id", "doc_id", "path", "filename", "file_type", "chunk_index", "score")


def search(index: Index, queries: Mapping[int, str], *, limit: int = 10, file_type: str | None = None, path: str | None = None) -> DataFrame:
    """query_id, rank, tier, chunk_id, doc_id, path, filename, file_type, chunk_index, content, score, best first."""
    top = ranked(index, queries, limit=limit, file_type=file_type, path=path)
    shown = index.chunks.select("chunk_id", "content").join(few(top, len(queries) * limit), "chunk_id")
    return shown.select("query_id", "rank", "tier", "chunk_id", "doc_id", "path", "filename", "file_type", "chunk_index", "content", "score")
