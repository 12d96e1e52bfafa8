"""Retrieval for natural questions: precise search, then pairs of tokens, then single tokens; and the context for them."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.shared import written
from .postings import Index
from .search import few, ranked, search

TOP_K, CONTEXT_CHARS = 5, 12_000
MOST_TOKENS, LEAST_LIMIT = 12, 10


def neighbours(chunks: DataFrame, hits: DataFrame, radius: int = 1) -> DataFrame:
    """For each hit (chunk_id, and any other columns): near, the chunks of its document within the radius, in order."""
    own = hits.join(chunks.select("chunk_id", F.col("doc_id").alias("_doc"), F.col("chunk_index").alias("_at")), "chunk_id")
    # an equi-join on document and each place within the radius, so the range costs no cross join
    places = own.withColumn("_place", F.explode(F.sequence(F.col("_at") - radius, F.col("_at") + radius)))
    near = places.join(chunks.select(F.col("doc_id").alias("_doc"), F.col("chunk_index").alias("_place"), F.col("content").alias("_content")), ["_doc", "_place"])
    listed = near.groupBy(*[F.col(f"`{c}`") for c in hits.columns]).agg(F.array_sort(F.collect_list(F.struct(F.col("_place").alias("chunk_index"), F.col("_content").alias("content")))).alias("near"))
    return listed


HITS = ["query_id", "rank", "chunk_id", "doc_id", "path", "filename", "file_type", "chunk_index", "content", "score"]


def rank_candidates(index: Index, questions: Mapping[int, list[str]], top_k: int, singles: bool) -> DataFrame:
    """Candidates of each question's pair (or single-token) searches, all searched at once, in their order."""
    asked: list[tuple[int, int, str]] = []
    for question_id, tokens in questions.items():
        own = tokens[:MOST_TOKENS]
        for text in own if singles else [f'"{a}" "{b}"' for a, b in combinations(own, 2)]:
            asked.append((len(asked), question_id, text))
    spark, limit = index.chunks.sparkSession, max(top_k, LEAST_LIMIT)
    owner = spark.createDataFrame([(k, q) for k, q, _ in asked], "query_id long, question_id long")
    wanted = spark.createDataFrame([(q, [t.casefold() for t in tokens[:MOST_TOKENS]]) for q, tokens in questions.items()], "question_id long, tokens array<string>")
    hits = ranked(index, {k: text for k, _, text in asked}, limit=limit).join(few(owner, len(asked)), "query_id")
    one = hits.groupBy("question_id", "chunk_id", "doc_id", "path", "filename", "file_type", "chunk_index").agg((F.lit(0) if singles else F.count("*")).cast("long").alias("pair_hits"), F.sum("rank").alias("rank_sum"), F.min_by("score", "query_id").alias("score"))
    shown = index.chunks.select("chunk_id", "content").join(few(one, len(asked) * limit), "chunk_id").join(few(wanted, len(questions)), "question_id")
    shown = shown.withColumn("matched", F.size(F.filter("tokens", lambda t: F.lower("content").contains(t))).cast("long")).withColumnRenamed("question_id", "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("pair_hits"), "rank_sum", "score", "path", "chunk_index")
    return shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def retrieve_hits(index: Index, questions: Mapping[int, str], top_k: int = TOP_K) -> DataFrame | None:
    """Ranked hits of all questions, None if none has a search token. Each fallback is one search for all questions that
    have no hit so far: their identifiers are all that comes to the driver."""
    if any(not q.strip() for q in questions.values()):
        raise ValueError("a question must not be blank")
    left = {k: t for k, q in questions.items() if (t := tx.question_tokens(q))}
    if not left:
        return None
    out = None
    for stage in (lambda t: search(index, {k: " ".join(x) for k, x in t.items()}, limit=top_k), lambda t: rank_candidates(index, t, top_k, False), lambda t: rank_candidates(index, t, top_k, True)):
        found = written(stage(left).select(*HITS), "hits")  # at most top_k rows a question
        out = found if out is None else out.unionByName(found)
        hit = {r[0] for r in found.select("query_id").distinct().collect()}
        left = {k: t for k, t in left.items() if k not in hit and len(t) > 1}
        if not left:
            break
    return out


PACKED = "query_id long, context string, truncated boolean, chunks array<struct<citation_id:int,chunk_id:long,path:string,filename:string,file_type:string,chunk_index:int,score:double,content:string,chunk_indexes:array<int>>>"


def pack_context(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """One row a question: its hits' windows as numbered blocks within `budget` characters. hits: from `retrieve_hits`
    with near. Blocks follow one another until one is cut or no room is left, so a question's few hits are taken in turn."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        text, taken, cut = "", [], False
        for r in rows.sort_values("rank").itertuples():
            near = [(int(n["chunk_index"]), n["content"]) for n in r.near]
            body = "\n\n".join(f"[分段 {i}]\n{c}" for i, c in near)
            gap = "\n\n" if text else ""
            head = f"[{len(taken) + 1}] 文件：{r.filename}；分段：{'、'.join(str(i) for i, _ in near)}\n"
            room = budget - len(text) - len(gap) - len(head)
            if room <= 0:
                cut = True
                break
            excerpt = body[:room].rstrip()
            if not excerpt:
                continue
            text += gap + head + excerpt
            taken.append({"citation_id": len(taken) + 1, "chunk_id": r.chunk_id, "path": r.path, "filename": r.filename, "file_type": r.file_type, "chunk_index": r.chunk_index, "score": r.score, "content": excerpt, "chunk_indexes": [i for i, _ in near]})
            if len(excerpt) < len(body):
                cut = True
                break
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "context": [text], "truncated": [cut or len(taken) < len(rows)], "chunks": [taken]})

    return hits.groupBy("query_id").applyInPandas(pack, PACKED)


def retrieve(index: Index, questions: Mapping[int, str], *, top_k: int = TOP_K, budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context, truncated, chunks for every question that finds something."""
    if top_k <= 0 or budget <= 0:
        raise ValueError("top_k and the budget must be positive")
    hits = retrieve_hits(index, questions, top_k)
    if hits is None:
        return index.chunks.sparkSession.createDataFrame([], PACKED)
    return pack_context(neighbours(index.chunks, hits.drop("content")), budget)
