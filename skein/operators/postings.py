"""Indexes over chunks: `token` (deduplicated search tokens) and `raw` (the content). What is kept is a row a chunk with its
terms in each field, in columns that are read one by one. Postings are made from it where they are asked for: kept by term, they
would have to be exploded and sorted through the whole corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

TIERS = {"token": 1, "raw": 2}


@dataclass(frozen=True)
class Index:
    """documents: doc_id, path, filename, file_type, ...; chunks: chunk_id, doc_id, chunk_index, content; terms: chunk_id,
    doc_id, chunk_index and, by field, an array of the chunk's terms in order and its length; stats: field, n_chunks,
    avg_length."""

    documents: DataFrame
    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame

    def by_field(self, *columns: str, terms: bool = True) -> DataFrame:
        """field, the columns, length, terms: a row for each chunk and field."""
        own = None
        for field in TIERS:
            one = self.terms.select(F.lit(field).alias("field"), *columns, F.col(f"{field}_length").alias("length"), *([F.col(field).alias("terms")] if terms else []))
            own = one if own is None else own.unionByName(one)
        return own

    @property
    def lengths(self) -> DataFrame:
        """field, chunk_id, length."""
        return self.by_field("chunk_id", terms=False)

    @property
    def postings(self) -> DataFrame:
        """field, term, chunk_id, length (of the chunk in that field), positions."""
        return self.by_field("chunk_id").select("field", "chunk_id", "length", F.inline(entries(F.col("terms")))).select("field", "term", "chunk_id", "length", "positions")


def entries(terms: Column) -> Column:
    """(term, positions) of each distinct term. Sorted inside the row, so a chunk's postings need no shuffle."""
    in_order = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("at"))))

    def of_order(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
        cut = lambda at, end: F.transform(F.slice(s, at + 1, end - at), lambda x: x["at"])
        return tx.let(firsts, lambda f: F.transform(f, lambda at, k: F.struct(F.get(s, at)["term"].alias("term"), cut(at, F.coalesce(F.get(f, k + 1), F.size(s))).alias("positions"))))

    none = F.array().cast("array<struct<term:string,positions:array<int>>>")
    return F.when(F.size(terms) > 0, tx.let(in_order, of_order)).otherwise(none)


def analysed(chunks: DataFrame) -> DataFrame:
    """`chunks` with their terms."""
    own = chunks.withColumns({"token": tx.token_terms(F.col("content")), "raw": tx.terms(F.col("content"))})
    return own.withColumns({f"{f}_length": F.size(f).cast("long") for f in TIERS})


def stats(lengths_: DataFrame) -> DataFrame:
    """Two rows. Chunks without terms count."""
    return lengths_.groupBy("field").agg(F.count("*").alias("n_chunks"), (F.sum("length") / F.count("*")).alias("avg_length"))


def term_stats(index: Index) -> DataFrame:
    """field, term, df, total occurrences."""
    # a term's occurrences in a chunk, of which one is marked as the first: no postings are made for it
    first = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    every = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    return index.by_field().select("field", F.inline(F.concat(first, every))).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def build(documents: DataFrame, chunks: DataFrame) -> Index:
    """An index that is not kept; each use computes it anew. `Store` writes one."""
    found = Index(documents, chunks, analysed(chunks), chunks)
    return Index(documents, chunks, found.terms, stats(found.lengths))
