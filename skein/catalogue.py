"""One query for each operator over the given tables, and the same in SQL. A row of `documents` plays a file: its source is
the directory and its language the type."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.chunking import chunked
from .operators import answers, evaluation, health, json_records, retrieval
from .operators import postings as po
from .operators.search import document_filter, scanned, search
from .plans.shared import shared_dir
from .plans.store import Store, changed
from .sources import files as fs

SEARCHES = {1: "the and", 2: "with this that", 3: "les des", 4: "nowhere zzzz"}
TIERED = {1: "the and", 2: "ê", 3: "zzzz qqqq"}
QUESTION = "What is the zzzz and with THIS?"
PHRASES = {1: '"of the"', 2: "foo_bar", 3: '"é é"', 4: '"è ê" "é é"', 5: '"é zzzz é"'}
QUESTIONS = {0: QUESTION, 1: "Is that of this?"}
HIGHLIGHT = '"of the" and'


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang")
    return raw_documents(spark, sf_dir).select("doc_id", path.alias("path"), name.alias("filename"), F.col("lang").alias("file_type"), F.col("n_chars").alias("size"), *more)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(raw_documents(spark, sf_dir).select("doc_id", tx.clean(F.col("text")).alias("text")))


_STORES: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> po.Index:
    """The corpus's index, written to the shared folder by the first query of an application that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        root = shared_dir(spark, "index")
        Store(spark, root).commit(documents(spark, sf_dir), chunks(spark, sf_dir))
        _STORES[key] = root
    return Store(spark, _STORES[key]).read()


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as files to be indexed."""
    return documents(spark, sf_dir, "text").select("path", "filename", "file_type", F.sha2("text", 256).alias("sha256"), "size", F.lit(0).cast("long").alias("modified_ns"), F.lit("").alias("parser_fingerprint"), "text")


SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
INNER = r"[\p{Z}\x09\x0b\x0c\x1c-\x1f\x85]"
SQL_CLEAN = rf"""cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(nfc_normalize(coalesce(text, '')), chr(65279), ''), chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m){INNER}+$', '', 'g'), '(?m)^{INNER}+', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACE}+', ''), '{SPACE}+$', '') AS text FROM documents)"""
SQL_CHUNKS = rf"""{SQL_CLEAN},
walk AS (SELECT doc_id, text AS rest, CAST(NULL AS VARCHAR) AS piece, 0 AS step FROM cleaned
  UNION ALL
  SELECT doc_id, CASE WHEN length(rest) > 800 THEN substr(rest, greatest(cut - 100, 1) + 1) ELSE '' END,
    regexp_replace(regexp_replace(CASE WHEN length(rest) > 800 THEN left(rest, cut) ELSE rest END, '^{SPACE}+', ''), '{SPACE}+$', ''), step + 1
  FROM (SELECT *, CASE WHEN m > 0 THEN 440 + m WHEN s > 0 THEN 440 + s - 1 ELSE 800 END AS cut FROM (
    SELECT *, length(regexp_extract(substr(rest, 441, 360), '^(?s:.*)[。！？.!?；;，,\n]')) AS m, length(regexp_extract(substr(rest, 441, 360), '^(?s:.*) ')) AS s FROM walk WHERE length(rest) > 0))),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_index, piece AS content FROM walk WHERE piece <> '')"""
SQL_FILES = "files AS (SELECT doc_id, '/' || source || '/' || doc_id || '.' || lang AS path, doc_id || '.' || lang AS filename, lang AS file_type, n_chars AS size FROM documents)"
SQL_TERMS = rf"""analysed AS (
  SELECT 'token' AS field, doc_id, chunk_index, regexp_extract_all(lower(array_to_string(list_distinct(list_filter(regexp_extract_all(content, '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]'), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))), ' ')), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS terms FROM chunks
  UNION ALL SELECT 'raw', doc_id, chunk_index, regexp_extract_all(lower(strip_accents(content)), '[\p{{L}}\p{{N}}\p{{Co}}]+') FROM chunks),
tf AS (SELECT field, doc_id, chunk_index, term, count(*) AS f FROM (SELECT field, doc_id, chunk_index, unnest(terms) AS term FROM analysed) GROUP BY ALL),
st AS (SELECT field, count(*) AS n_chunks, sum(len(terms)) / count(*) AS avg_length FROM analysed GROUP BY field)"""


def sql_queries(queries: dict[int, str], phrases: bool = False) -> str:
    rows = []
    for q, query in queries.items():
        words = tx.query_terms(query)
        for field, parts in (("token", tx.plain_tokens(" ".join(words))), ("raw", words)):
            cut = [tx.plain_terms(p) for p in parts]
            if all(cut) and (phrases or all(len(c) == 1 for c in cut)):
                rows += [f"({q}, '{field}', {len(cut)}, {no}, {c if phrases else repr(c[0])})" for no, c in enumerate(cut)]
    return f"asked AS (SELECT * FROM (VALUES {', '.join(rows)}) v(query_id, field, n_terms, term_no, {'phrase' if phrases else 'term'}))"


SQL_PHRASES = """hits AS (SELECT *, count(*) OVER (PARTITION BY query_id, field, term_no) AS df FROM (
  SELECT a.query_id, a.field, a.n_terms, a.term_no, t.doc_id, t.chunk_index, len([i FOR i IN range(1, len(terms) + 1) IF terms[i : i + len(phrase) - 1] = phrase]) AS f FROM asked a JOIN analysed t ON a.field = t.field) WHERE f > 0),
"""
SQL_HITS = """hits AS (SELECT a.query_id, a.field, a.n_terms, a.term_no, t.doc_id, t.chunk_index, t.f, count(*) OVER (PARTITION BY a.query_id, a.field, a.term_no) AS df FROM asked a JOIN tf t ON a.field = t.field AND a.term = t.term),
"""
SQL_SCORES = """scores AS (SELECT h.query_id, h.field, h.doc_id, h.chunk_index, -sum(greatest(ln((n_chunks - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(terms) / avg_length)) ORDER BY h.term_no) AS score
  FROM hits h JOIN analysed a ON h.field = a.field AND h.doc_id = a.doc_id AND h.chunk_index = a.chunk_index JOIN st ON st.field = h.field GROUP BY h.query_id, h.field, h.doc_id, h.chunk_index, h.n_terms HAVING count(*) = h.n_terms)"""


def sql_search(queries: dict[int, str], limit: int, where: str = "true", phrases: bool = False) -> str:
    return f"""WITH RECURSIVE {SQL_CHUNKS}, {SQL_FILES}, {SQL_TERMS}, {sql_queries(queries, phrases)}, {SQL_PHRASES if phrases else SQL_HITS}{SQL_SCORES},
tiers AS (SELECT s.*, CASE field WHEN 'token' THEN 1 ELSE 2 END AS tier, f.path, f.filename, f.file_type FROM scores s JOIN files f ON s.doc_id = f.doc_id WHERE {where}),
firsts AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS first_tier FROM tiers),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, path, chunk_index) AS INTEGER) AS rank FROM firsts WHERE tier = first_tier QUALIFY rank <= {limit})"""


SQL_FOUND = "SELECT CAST(query_id AS BIGINT) AS query_id, rank, tier, doc_id, path, chunk_index, round(score, 6) AS score FROM found"


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "tier", "doc_id", "path", "chunk_index", F.round("score", 6).alias("score"))


def q_clean(spark, d):
    return raw_documents(spark, d).select("doc_id", tx.clean(F.col("text")).alias("text"))


def q_tokens(spark, d):
    return raw_documents(spark, d).select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))


def q_terms(spark, d):
    return raw_documents(spark, d).select("doc_id", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def q_chunks(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", "content")


def q_postings(spark, d):
    return po.term_stats(index(spark, d))


def q_stats(spark, d):
    return index(spark, d).stats.select("field", "n_chunks", F.round("avg_length", 6).alias("avg_length"))


def q_search(spark, d):
    return shown(search(index(spark, d), SEARCHES, limit=10))


def q_filtered(spark, d):
    return shown(search(index(spark, d), SEARCHES, limit=10, file_type=".EN", path="/src1/"))


def q_tiers(spark, d):
    return shown(search(index(spark, d), TIERED, limit=10))


def q_phrase(spark, d):
    return shown(search(index(spark, d), PHRASES, limit=10))


def q_like(spark, d):
    return chunks(spark, d).where(tx.like_all(F.col("content"), "TH_ %ion")).select("doc_id", "chunk_index", F.lit(0.0).alias("score"))


def q_like_cjk(spark, d):
    """The tables hold no such characters: every 5th document's chunks get some."""
    i = index(spark, d)
    more = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("中文TH_x "), F.col("doc_id").cast("string"))).otherwise("")
    i = replace(i, chunks=i.chunks.withColumn("content", F.concat("content", more)))
    return scanned(i, spark, {1: "中文", 2: "文th_ the", 3: "plain words", 4: "漢"}).select("query_id", "tier", "doc_id", "chunk_index", "score")


def q_highlight(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", tx.highlight(F.col("content"), HIGHLIGHT).alias("highlighted"))


def q_window(spark, d):
    own = chunks(spark, d)
    near = retrieval.neighbours(own, own.select("chunk_id", F.col("doc_id").alias("of_doc"), F.col("chunk_index").alias("of_chunk")))
    return near.select("of_doc", "of_chunk", F.inline("near")).select("of_doc", "of_chunk", "chunk_index")


def q_pairs(spark, d):
    hits = retrieval.rank_candidates(index(spark, d), {0: ["the", "zzzz", "and", "with"]}, 10, False)
    return hits.select("doc_id", "chunk_index", "matched", "pair_hits", "rank_sum", "rank")


def q_singles(spark, d):
    hits = retrieval.rank_candidates(index(spark, d), {0: ["the", "zzzz"]}, 10, True)
    return hits.select("doc_id", "chunk_index", "matched", "pair_hits", "rank_sum", "rank")


def q_retrieve(spark, d):
    return retrieval.retrieve(index(spark, d), QUESTIONS).select("query_id", "truncated", F.length("context").alias("context_chars"), F.size("chunks").alias("n_chunks"))


def q_context(spark, d):
    return retrieval.retrieve(index(spark, d), {0: QUESTION}, top_k=3, budget=2000).select("query_id", "truncated", "context", F.array_join(F.transform("chunks", lambda c: c["citation_id"].cast("string")), ",").alias("citation_ids"))


def q_list(spark, d):
    return health.listed(documents(spark, d), chunks(spark, d)).select("doc_id", "path", "filename", "file_type", "size", "chunk_count")


def q_counts(spark, d):
    return health.counts(index(spark, d))


def q_health(spark, d):
    """The index, damaged: documents of one source are gone, and every 7th document's chunks."""
    i = index(spark, d)
    return health.issues(replace(i, documents=i.documents.where(~F.col("path").startswith("/src3/")), chunks=i.chunks.where("doc_id % 7 <> 0")))


def q_changes(spark, d):
    """Every 5th text has changed since."""
    now = raw_documents(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.lit("p").alias("parser_fingerprint"), F.lit("found").alias("status"))
    before = now.select("path", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), "parser_fingerprint")
    return changed(now, before).select("doc_id", "sha256", "status")


def q_prune(spark, d):
    """Files of one source no longer exist."""
    store, files = Store(spark, shared_dir(spark, "store")), filed(spark, d)
    store.replace(files)
    store.prune(files.where(~F.col("path").startswith("/src2/")).select("path"))
    now = store.read()
    return health.listed(now.documents, now.chunks).select("path", "chunk_count")


def q_remove(spark, d):
    """Two of the documents of one source are removed."""
    store = Store(spark, shared_dir(spark, "store"))
    store.replace(filed(spark, d).where(F.col("path").startswith("/src1/")))
    first, last = store.read().documents.agg(F.min("path"), F.max("path")).first()
    for path in (first, last, "/src1/none"):
        store.remove(path)
    now = store.read()
    return now.postings.join(now.chunks, "chunk_id").join(now.documents, "doc_id").groupBy("path").agg(F.count_distinct("chunk_index").alias("n_chunks"), F.count("*").alias("n_postings"))


def q_path_forms(spark, d):
    """A directory and a file, each by a path that has to be made absolute."""
    files = documents(spark, d)
    forms = {"directory": "/nowhere/../src1/", "file": "/src1/./../src2/52.en", "no_directory": "/src1"}
    found = [document_filter(files, None, path).select(F.lit(form).alias("form"), "path") for form, path in forms.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def q_json_index(spark, d):
    """Events as files of a hundred records each, every record chunked on its own and numbered on in its file."""
    no = F.floor(F.col("event_id") / 100).cast("long")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda r: r["props"])  # a hundred
    files = events(spark, d).where("props IS NOT NULL").groupBy(no.alias("no")).agg(F.concat(F.lit("[\n"), F.array_join(listed, ",\n"), F.lit("]")).alias("text")).select(F.col("no").cast("string").alias("path"), "text")
    found = json_records.extracted(files, json_records.Profile.from_config({"fields": ["k"]}))
    parts = found.select("path", F.col("record_no").alias("part"), tx.clean(F.col("text")).alias("text"))
    return chunked(parts, key="path", part="part").select("path", "chunk_index", "content")


def q_path_filter(spark, d):
    return document_filter(documents(spark, d), "EN", "/src1/").select("doc_id", "path")


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "props")


def q_json_fields(spark, d):
    return json_records.field_texts(events(spark, d), "props", {"k": "$.k", "missing": "$.zzz"}).select("event_id", "k", "missing")


def q_json_filter(spark, d):
    rules = [{"path": "$.k", "exists": True}, {"path": "$.k", "not_equals": 3}, {"path": "$.k", "in": [1, 2, 3, 69]}]
    return events(spark, d).where(json_records.where_json(F.col("props"), rules)).select("event_id")


def q_json_extract(spark, d):
    profile = json_records.Profile.from_config({"fields": [{"name": "key", "path": "k"}, "zzz"], "filter": {"path": "k", "exists": True}})
    files = events(spark, d).select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    return json_records.extracted(files, profile).select("path", "record_no", "block_no", "text", "error")


def q_json_structure(spark, d):
    return json_records.structure(events(spark, d), "props")


def q_json_preview(spark, d):
    profile = json_records.Profile.from_config({"fields": ["k"]})
    files = events(spark, d).select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    return json_records.preview(files, profile, 5).select("path", "text")


def q_citations(spark, d):
    """Turns as answers: citations are made from the turn's number."""
    own = spark.read.parquet(f"{d}/conversations.parquet")
    said = F.concat(F.when(F.col("turn") % 4 == 3, answers.REFUSAL).otherwise(""), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 > 0, F.concat(F.lit(" ["), F.col("turn").cast("string"), F.lit("][1]"))).otherwise(""))
    return answers.validated(own.select("conv_id", "turn", said.alias("answer"), F.array(F.lit(1), F.lit(2)).alias("available"))).select("conv_id", "turn", "refused", F.array_join("cited", ",").alias("cited"), "error")


CASES = [
    ("c1", "fact", "q1", ["a.md"], False, [("x", ["ratio 3:1"], ["3：1"]), ("y", ["blue"], ["Blue"])]),
    ("c2", "fact", "q2", ["a.md", "b.md"], False, [("z", ["seven", "7"], ["7 units"])]),
    ("c3", "refusal", "q3", ["c.md"], True, []),
]
RECORDS = [
    (1, "q1", "old", False, 5.0, [(1, "a.md", "nothing")]),
    (2, "q1", "The **ratio 3:1** is `blue` [1]", False, 10.0, [(1, "a.md", "ratio 3：1 and blue"), (2, "b.md", "other")]),
    (3, "q2", "It is 7 [1]", False, 20.0, [(1, "a.md", "7 units"), (2, "b.md", "none")]),
    (4, "q3", answers.REFUSAL + "[1]", True, 30.0, [(1, "c.md", "")]),
]


def q_scores(spark, d):
    cases = spark.createDataFrame(CASES, "case_id string, kind string, question string, expected_sources array<string>, expected_refused boolean, facts array<struct<label:string,answer_any:array<string>,evidence_any:array<string>>>")
    rows = [(n, json.dumps({"event": "rag_answer", "question": q, "answer": a, "refused": r, "elapsed_ms": ms, "retrieval_results": [{"citation_id": i, "filename": f, "content": c} for i, f, c in found]})) for n, q, a, r, ms, found in RECORDS]
    records = spark.createDataFrame(rows, "record_no long, line string").select("record_no", F.from_json("line", evaluation.RECORD).alias("r")).select("record_no", "r.*")
    return evaluation.scored(cases, records).select("case_id", "supported_facts", "total_facts", "retrieved_source", "cited_source", "citations_valid", "refusal_correct", "passed")


def q_discover(spark, d):
    """A tree of small files, made for this."""
    root = shared_dir(spark, "files").removeprefix("file://")
    for name in ("a.txt", "b.md", "c.json", "sub/d.TXT", "sub/e.bin", "build/f.txt", "skip/g.md"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", encoding="utf-8") as file:
            file.write(name)
    return fs.scan(spark, list(fs.discover([root, root + "/sub"], exclude_dirs=["skip"]))).select("ordinal", "filename", "file_type", "size", "status", "sha256")


def q_store(spark, d):
    """An index written, updated and read back: documents by status of their chunks."""
    store, files = Store(spark, shared_dir(spark, "store")), filed(spark, d)
    store.replace(files)
    store.replace(files.where(F.col("path").startswith("/src1/")).withColumn("text", F.lit("")))
    now = store.read()
    return health.listed(now.documents, now.chunks).select("path", "chunk_count")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "clean_text_documents": q_clean, "fallback_tokens": q_tokens, "unicode61_terms": q_terms, "chunk_documents": q_chunks,
        "postings_term_stats": q_postings, "postings_field_stats": q_stats, "bm25_and_search": q_search, "bm25_filtered_search": q_filtered,
        "tiered_search_batch": q_tiers, "phrase_search": q_phrase, "like_fallback": q_like, "like_fallback_cjk": q_like_cjk, "highlight_hits": q_highlight,
        "chunk_window": q_window, "pair_retrieval": q_pairs, "single_token_fallback": q_singles, "question_retrieval": q_retrieve, "context_packing": q_context,
        "list_documents": q_list, "index_counts": q_counts, "health_check": q_health, "incremental_diff": q_changes, "prune_missing": q_prune,
        "remove_document": q_remove, "document_filters": q_path_filter, "json_props_fields": q_json_fields, "json_filters": q_json_filter,
        "json_extract": q_json_extract, "json_structure": q_json_structure, "json_preview": q_json_preview, "citation_validate": q_citations,
        "eval_scoring": q_scores, "file_discovery": q_discover, "store_snapshots": q_store, "path_filter_forms": q_path_forms,
        "json_index_record_mode": q_json_index,
    }


def oracle_sql() -> dict[str, str]:
    chunked_ = f"WITH RECURSIVE {SQL_CHUNKS}"
    ranked = """per_hit AS (SELECT doc_id, chunk_index, path, CAST({pairs} AS BIGINT) AS pair_hits, CAST(sum(rank) AS BIGINT) AS rank_sum, min_by(score, query_id) AS score FROM found GROUP BY ALL),
counted AS (SELECT p.*, CAST({matched} AS BIGINT) AS matched FROM per_hit p JOIN chunks c ON p.doc_id = c.doc_id AND p.chunk_index = c.chunk_index)
SELECT doc_id, chunk_index, matched, pair_hits, rank_sum, CAST(row_number() OVER (ORDER BY matched DESC, pair_hits DESC, rank_sum, score, path, chunk_index) AS INTEGER) AS rank FROM counted QUALIFY rank <= 10"""
    matched = lambda words: " + ".join(f"CAST(contains(lower(c.content), '{w}') AS INTEGER)" for w in words)
    pairs = {k: q for k, q in enumerate(["the zzzz", "the and", "the with", "zzzz and", "zzzz with", "and with"])}
    said = f"(CASE WHEN turn % 4 = 3 THEN '{answers.REFUSAL}' ELSE '' END || coalesce(text, '') || CASE WHEN turn % 3 > 0 THEN ' [' || turn || '][1]' ELSE '' END)"
    question_pairs = {k: q for k, q in enumerate(["zzzz and", "zzzz with", "zzzz THIS", "and with", "and THIS", "with THIS"])}
    pair_hits = ranked.replace("GROUP BY ALL", "WHERE query_id < 100 GROUP BY ALL").replace("rank <= 10", "rank <= {k}").replace("SELECT doc_id, chunk_index, matched", ", hits_of_0 AS (SELECT doc_id, chunk_index, matched").replace(")\n, hits_of_0", "),\nhits_of_0").format(pairs="count(*)", matched=matched(["zzzz", "and", "with", "this"]), k="{k}") + ")"
    asked_1 = "UNION ALL SELECT 1 AS query_id, rank, doc_id, chunk_index FROM found WHERE query_id = 100 AND rank <= 5"

    def context(top: int, budget: int, more: str = "") -> str:
        return f"""{sql_search(question_pairs | {100: "that of this"}, 10)}, {pair_hits.format(k=top)},
asked_for AS (SELECT 0 AS query_id, rank, doc_id, chunk_index FROM hits_of_0 {more}),
bodies AS (SELECT h.query_id, h.rank, any_value(f.filename) AS filename, string_agg('[分段 ' || c.chunk_index || ']' || chr(10) || c.content, chr(10) || chr(10) ORDER BY c.chunk_index) AS body, string_agg(CAST(c.chunk_index AS VARCHAR), '、' ORDER BY c.chunk_index) AS places
  FROM asked_for h JOIN files f ON h.doc_id = f.doc_id JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY h.query_id, h.rank),
pack AS (SELECT DISTINCT query_id, 0 AS rank, '' AS text, 0 AS taken, false AS cut FROM bodies
  UNION ALL
  SELECT query_id, rank + 1, CASE WHEN room > 0 AND excerpt <> '' THEN text || gap || head || excerpt ELSE text END, CASE WHEN room > 0 AND excerpt <> '' THEN taken + 1 ELSE taken END, room <= 0 OR (excerpt <> '' AND length(excerpt) < length(body))
  FROM (SELECT *, regexp_replace(left(body, greatest(room, 0)), '{SPACE}+$', '') AS excerpt FROM (SELECT *, {budget} - length(text) - length(gap) - length(head) AS room FROM (
    SELECT p.*, b.body, CASE WHEN p.text = '' THEN '' ELSE chr(10) || chr(10) END AS gap, '[' || (p.taken + 1) || '] 文件：' || b.filename || '；分段：' || b.places || chr(10) AS head FROM pack p JOIN bodies b ON b.query_id = p.query_id AND b.rank = p.rank + 1 WHERE NOT p.cut)))),
last AS (SELECT *, taken AS n_chunks, cut OR taken < (SELECT count(*) FROM bodies b WHERE b.query_id = pack.query_id) AS truncated FROM pack QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1)"""

    return {
        "phrase_search": sql_search(PHRASES, 10, phrases=True) + SQL_FOUND,
        "like_fallback_cjk": f"{chunked_}, more AS (SELECT doc_id, chunk_index, translate(content || CASE WHEN doc_id % 5 = 0 THEN '中文TH_x ' || doc_id ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM chunks) SELECT CAST(query_id AS BIGINT) AS query_id, 3 AS tier, doc_id, chunk_index, CAST(0 AS DOUBLE) AS score FROM (SELECT 1 AS query_id, * FROM more WHERE content LIKE '%中文%' UNION ALL SELECT 2, * FROM more WHERE content LIKE '%文th_%' AND content LIKE '%the%')",
        "question_retrieval": context(5, retrieval.CONTEXT_CHARS, asked_1) + " SELECT CAST(query_id AS BIGINT) AS query_id, truncated, CAST(length(text) AS INTEGER) AS context_chars, CAST(n_chunks AS INTEGER) AS n_chunks FROM last",
        "context_packing": context(3, 2000) + " SELECT CAST(query_id AS BIGINT) AS query_id, truncated, text AS context, array_to_string(range(1, n_chunks + 1), ',') AS citation_ids FROM last",
        "file_discovery": "SELECT CAST(o AS BIGINT) AS ordinal, string_split(name, '/')[-1] AS filename, kind AS file_type, CAST(length(name) AS BIGINT) AS size, 'found' AS status, sha256(name) AS sha256 FROM (VALUES (0, 'a.txt', 'txt'), (1, 'b.md', 'md'), (2, 'sub/d.TXT', 'txt')) v(o, name, kind)",
        "path_filter_forms": f"WITH {SQL_FILES} SELECT 'directory' AS form, path FROM files WHERE starts_with(path, '/src1/') UNION ALL SELECT 'file', path FROM files WHERE path = '/src2/52.en'",
        "json_index_record_mode": "SELECT CAST(event_id // 100 AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS chunk_index, props ->> '$.k' AS content FROM events WHERE coalesce(props ->> '$.k', '') <> ''",
        "clean_text_documents": f"WITH {SQL_CLEAN} SELECT doc_id, text FROM cleaned",
        "fallback_tokens": r"SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]')) AS token FROM documents) WHERE regexp_matches(token, '[\p{L}\p{N}]')",
        "unicode61_terms": r"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}\p{Co}]+')) AS term FROM documents) GROUP BY ALL",
        "chunk_documents": f"{chunked_} SELECT doc_id, chunk_index, content FROM chunks",
        "postings_term_stats": f"{chunked_}, {SQL_TERMS} SELECT field, term, count(*) AS df, CAST(sum(f) AS BIGINT) AS cf FROM tf GROUP BY ALL",
        "postings_field_stats": f"{chunked_}, {SQL_TERMS} SELECT field, n_chunks, round(avg_length, 6) AS avg_length FROM st",
        "bm25_and_search": sql_search(SEARCHES, 10) + SQL_FOUND,
        "bm25_filtered_search": sql_search(SEARCHES, 10, "f.file_type = 'en' AND starts_with(f.path, '/src1/')") + SQL_FOUND,
        "tiered_search_batch": sql_search(TIERED, 10) + SQL_FOUND,
        "like_fallback": f"{chunked_} SELECT doc_id, chunk_index, CAST(0 AS DOUBLE) AS score FROM chunks WHERE translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_%' AND translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%%ion%'",
        "highlight_hits": f"{chunked_} SELECT doc_id, chunk_index, regexp_replace(content, 'of the|and', '<mark>\\0</mark>', 'gi') AS highlighted FROM chunks",
        "chunk_window": f"{chunked_} SELECT a.doc_id AS of_doc, a.chunk_index AS of_chunk, b.chunk_index FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1",
        "pair_retrieval": sql_search(pairs, 10) + ", " + ranked.format(pairs="count(*)", matched=matched(["the", "zzzz", "and", "with"])),
        "single_token_fallback": sql_search({0: "the", 1: "zzzz"}, 10) + ", " + ranked.format(pairs="0", matched=matched(["the", "zzzz"])),
        "list_documents": f"{chunked_}, {SQL_FILES} SELECT f.doc_id, f.path, f.filename, f.file_type, f.size, count(c.doc_id) AS chunk_count FROM files f LEFT JOIN chunks c ON f.doc_id = c.doc_id GROUP BY ALL",
        "index_counts": f"{chunked_}, {SQL_TERMS} SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'lengths_' || field, count(*) FROM analysed GROUP BY field UNION ALL SELECT 'postings', count(*) FROM tf",
        "health_check": f"""{chunked_}, {SQL_TERMS}, docs AS (SELECT doc_id FROM documents WHERE source <> 'src3'), kept AS (SELECT * FROM chunks WHERE doc_id % 7 <> 0), rules AS (
  SELECT 'orphan_chunks' AS rule, count(*) AS n FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM docs)
  UNION ALL SELECT 'documents_without_chunks', count(*) FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM kept)
  UNION ALL SELECT field || '_extra', count(*) FROM analysed WHERE doc_id % 7 = 0 GROUP BY field) SELECT rule, n FROM rules WHERE n > 0""",
        "incremental_diff": "SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'to_index' ELSE 'skipped' END AS status FROM documents",
        "prune_missing": f"{chunked_}, {SQL_FILES} SELECT f.path, count(*) AS chunk_count FROM files f JOIN chunks c ON f.doc_id = c.doc_id WHERE NOT starts_with(f.path, '/src2/') GROUP BY f.path",
        "remove_document": f"{chunked_}, {SQL_TERMS}, {SQL_FILES}, own AS (SELECT f.path, c.doc_id, c.chunk_index FROM files f JOIN chunks c ON f.doc_id = c.doc_id WHERE starts_with(f.path, '/src1/')) SELECT o.path, count(DISTINCT o.chunk_index) AS n_chunks, count(*) AS n_postings FROM own o JOIN tf t ON o.doc_id = t.doc_id AND o.chunk_index = t.chunk_index WHERE o.path NOT IN (SELECT min(path) FROM own UNION ALL SELECT max(path) FROM own) GROUP BY o.path",
        "document_filters": f"WITH {SQL_FILES} SELECT doc_id, path FROM files WHERE file_type = 'en' AND starts_with(path, '/src1/')",
        "json_props_fields": "SELECT event_id, coalesce(props ->> '$.k', '') AS k, coalesce(props ->> '$.zzz', '') AS missing FROM events",
        "json_filters": "SELECT event_id FROM events WHERE CAST(props ->> '$.k' AS BIGINT) IN (1, 2, 69)",
        "json_extract": "SELECT CAST(event_id AS VARCHAR) AS path, CAST(0 AS BIGINT) AS record_no, CAST(0 AS INTEGER) AS block_no, 'key: ' || (props ->> '$.k') AS text, CAST(NULL AS VARCHAR) AS error FROM events WHERE props ->> '$.k' IS NOT NULL",
        "json_structure": "SELECT '$' AS path, 'object' AS kind, count(*) AS n FROM events WHERE props IS NOT NULL UNION ALL SELECT '$.k', 'integer', count(*) FROM events WHERE props ->> '$.k' IS NOT NULL",
        "json_preview": "SELECT CAST(event_id AS VARCHAR) AS path, props ->> '$.k' AS text FROM events WHERE props ->> '$.k' IS NOT NULL ORDER BY path LIMIT 5",
        "citation_validate": f"""WITH a AS (SELECT conv_id, turn, {said} AS answer FROM conversations), c AS (SELECT *, starts_with(answer, '{answers.REFUSAL_PREFIX}') AS refused, list_sort(list_distinct([CAST(x AS INTEGER) FOR x IN regexp_extract_all(answer, '\\[(\\d{{1,9}})\\]', 1)])) AS ids FROM a),
e AS (SELECT *, [x FOR x IN ids IF x NOT IN (1, 2)] AS strange FROM c)
SELECT conv_id, turn, refused, array_to_string(ids, ',') AS cited, CASE WHEN len(strange) > 0 THEN 'invalid:' || array_to_string(strange, ',') WHEN NOT refused AND len(ids) = 0 THEN 'missing' END AS error FROM e""",
        "eval_scoring": "SELECT * FROM (VALUES ('c1', CAST(2 AS BIGINT), CAST(2 AS BIGINT), true, true, true, true, true), ('c2', 1, 1, true, false, true, true, false), ('c3', 0, 0, true, true, true, true, true)) v(case_id, supported_facts, total_facts, retrieved_source, cited_source, citations_valid, refusal_correct, passed)",
        "store_snapshots": f"{chunked_}, {SQL_FILES} SELECT f.path, count(*) AS chunk_count FROM files f JOIN chunks c ON f.doc_id = c.doc_id WHERE NOT starts_with(f.path, '/src1/') GROUP BY f.path",
    }
