"""Scoring audit records against evaluation cases, as one join."""

from __future__ import annotations

import contextlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.files import audit_records
from .answers import MARKER, Client, ModelError, Settings, ask, audit_table, response
from .postings import Index

RECORD = """event string, question string, answer string, refused boolean, elapsed_ms double, context_chars int, context_truncated boolean,
retrieval_results array<struct<citation_id:int,filename:string,chunk_index:int,chunk_indexes:array<int>,content:string>>,
token_usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"""


def scored(cases: DataFrame, records: DataFrame) -> DataFrame:
    """cases: case_id, kind, question, expected_sources, expected_refused, facts (label, answer_any, evidence_any).
    records: RECORD, and record_no; of one question the last counts. A case without record has passed = false."""
    last = records.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("record_no")))).where("_n = 1").drop("_n", "event", "record_no")
    df = cases.join(last, "question", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    found = F.coalesce("retrieval_results", F.array().cast("array<struct<citation_id:int,filename:string,chunk_index:int,chunk_indexes:array<int>,content:string>>"))
    df = df.withColumn("retrieval_results", found).withColumn("citation_ids", F.array_sort(F.array_distinct(tx.citations(F.col("answer")))))
    df = df.withColumn("cited", F.filter("retrieval_results", lambda r: F.array_contains("citation_ids", r["citation_id"])))
    evidence = F.array_join(F.transform("cited", lambda r: F.coalesce(r["content"], F.lit(""))), "\n")
    df = df.withColumn("evidence", evidence)
    checks = F.transform("facts", lambda f: F.struct(f["label"].alias("label"), tx.contains_any(F.col("answer"), f["answer_any"]).alias("answer_match"), tx.contains_any(F.col("evidence"), f["evidence_any"]).alias("evidence_match")))
    df = df.withColumn("fact_checks", F.transform(checks, lambda c: c.withField("supported", c["answer_match"] & c["evidence_match"])))
    all_in = lambda rows: F.size(F.array_intersect(F.transform(rows, lambda r: r["filename"]), "expected_sources")) == F.size("expected_sources")
    supported = F.size(F.filter("fact_checks", lambda c: c["supported"])).cast("long")
    df = df.withColumns({
        "retrieved_source": all_in(F.col("retrieval_results")),
        "cited_source": all_in(F.col("cited")),
        "citations_valid": (F.size("citation_ids") > 0) & (F.size(F.array_distinct(F.transform("cited", lambda r: r["citation_id"]))) == F.size("citation_ids")),
        "actual_refused": F.coalesce("refused", F.lit(False)),
        "supported_facts": supported,
        "total_facts": F.size("facts").cast("long"),
    })
    excerpts = F.transform("facts", lambda f: f["evidence_any"])
    whole = F.concat_ws("\n", F.transform("cited", lambda r: r["content"]))
    return df.withColumns({
        "refusal_correct": F.col("actual_refused") == F.col("expected_refused"),
        "support_rate": F.when(F.col("total_facts") > 0, F.col("supported_facts") / F.col("total_facts")).otherwise(1.0),
        "excerpt": tx.relevant_excerpt(whole, excerpts),
    }).withColumn("passed", (F.col("supported_facts") == F.col("total_facts")) & F.col("retrieved_source") & F.col("cited_source") & F.col("citations_valid") & F.col("refusal_correct"))


CASE = "id string, kind string, question string, expected_source string, expected_sources array<string>, expected_refused boolean, facts array<struct<label:string,answer_any:array<string>,evidence_any:array<string>>>"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file; a case names one expected source or a list of them."""
    rows = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    questions = [r.get("question") if isinstance(r, dict) else None for r in rows] if isinstance(rows, list) else []
    if not questions or not all(isinstance(q, str) and q.strip() for q in questions) or len(set(questions)) < len(questions):
        raise ValueError("cases are a list of objects, each with a question of its own")
    if any((r.get("expected_source") is None) == (r.get("expected_sources") is None) for r in rows):
        raise ValueError("a case has either expected_source or expected_sources")
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", CASE).alias("c")).select("c.*")
    sources = F.coalesce("expected_sources", F.array("expected_source"))
    return df.select(F.col("id").alias("case_id"), "kind", "question", sources.alias("expected_sources"), F.coalesce("expected_refused", F.lit(False)).alias("expected_refused"), F.coalesce("facts", F.array().cast("array<struct<label:string,answer_any:array<string>,evidence_any:array<string>>>")).alias("facts"))


def run(index: Index, asked: DataFrame, log: str, client: Client | None, settings: Settings | None = None, **secrets) -> DataFrame:
    """Asks every case's question, one run a file, which is begun anew; returns the audit records. A question that the model
    fails on is a record too. Cases are few, and each is a call to the model."""
    spark = asked.sparkSession
    Path(log).parent.mkdir(parents=True, exist_ok=True)
    Path(log).write_text("", encoding="utf-8")
    for question in [r[0] for r in asked.select("question").collect()]:
        with contextlib.suppress(ModelError):
            ask(index, question, client, settings, audit=audit_table(log), **secrets)
    return audit_records(spark, Path(log).resolve().as_uri(), MARKER, RECORD)


CLEANED = ["case_id", "kind", "question", "answer", "expected_sources", "retrieved_source", "cited_source", "citation_ids", "citations_valid", "expected_refused", "actual_refused", "refusal_correct", "fact_checks", "supported_facts", "total_facts", "support_rate", "passed", "cited_evidence", "elapsed_ms", "token_usage", "context_chars", "context_truncated"]


def cleaned(scores: DataFrame) -> DataFrame:
    """A record for each case: its checks, and an excerpt of each cited chunk in place of its content."""
    wanted = F.transform("facts", lambda f: f["evidence_any"])
    places = lambda r: F.coalesce(r["chunk_indexes"], F.array(r["chunk_index"]))
    shown = F.transform("cited", lambda r: F.struct(r["citation_id"].alias("citation_id"), r["filename"].alias("filename"), places(r).alias("chunk_indexes"), tx.relevant_excerpt(r["content"], wanted).alias("excerpt")))
    return scores.withColumn("cited_evidence", shown).select(*CLEANED)


def write_cleaned(scores: DataFrame, path: str) -> None:
    """JSON lines, one a case, in the cases' order. Cases are few."""
    lines = cleaned(scores).orderBy("case_id").select(F.to_json(F.struct(*CLEANED), {"ignoreNullFields": "false"})).collect()
    Path(path).write_text("".join(f"{r[0]}\n" for r in lines), encoding="utf-8")


def without_context(cases_: DataFrame, client: Client, settings: Settings | None = None) -> DataFrame:
    """Ablation: the model is asked without any context. case_id, answer, matched (labels of facts that its answer holds all
    the same), total_tokens."""
    rows = []
    for r in cases_.select("case_id", "question").collect():  # cases are few
        answer, usage = response(client([{"role": "user", "content": r["question"]}], (settings or Settings()).temperature))
        rows.append((r["case_id"], answer, usage["total_tokens"]))
    said = cases_.sparkSession.createDataFrame(rows, "case_id string, answer string, total_tokens int")
    held = F.transform(F.filter("facts", lambda f: tx.contains_any(F.col("answer"), f["answer_any"])), lambda f: f["label"])
    return said.join(cases_, "case_id").select("case_id", "answer", held.alias("matched"), "total_tokens")


def summary(scores: DataFrame) -> DataFrame:
    """One row: cases, passed, supported and total facts, mean time, tokens."""
    return scores.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.sum("supported_facts").alias("supported_facts"), F.sum("total_facts").alias("total_facts"), F.avg("elapsed_ms").alias("mean_ms"), F.sum("token_usage.total_tokens").alias("total_tokens"))


def report(scores: DataFrame) -> str:
    """A Markdown report; evaluation cases are few."""
    s = scores.transform(summary).first()
    lines = ["# Evaluation", "", f"- cases passed: {s['passed']}/{s['cases']}", f"- facts supported: {s['supported_facts']}/{s['total_facts']}", f"- mean time: {s['mean_ms'] or 0:.1f} ms, tokens: {s['total_tokens'] or 0}", "", "| case | passed | facts | ms |", "|---|---|---|---|"]
    lines += [f"| {r['case_id']} | {r['passed']} | {r['supported_facts']}/{r['total_facts']} | {r['elapsed_ms'] or 0:.1f} |" for r in scores.orderBy("case_id").collect()]
    return "\n".join(lines) + "\n"
