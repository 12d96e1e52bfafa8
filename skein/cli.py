"""Command line: index, search, ask, eval, stats, list, remove, prune, check-db, init-db, json-preview, json-structure."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import answers, evaluation, health, json_records
from .operators.client import KEY, URL, HttpClient, settings
from .operators.search import search
from .plans.store import Store
from .sources import files as fs


KINDS = ["txt", "md", "pdf", "pptx", "json"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein")
    shared = [("--db", {"default": "skein-store"}), ("--log-file", {"default": "logs/skein.log"}), ("--log-level", {"choices": ["DEBUG", "INFO", "WARNING", "ERROR"], "default": "INFO"})]
    for flag, how in shared:
        top.add_argument(flag, **how)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        own = sub.add_parser(name)
        for flag, how in shared:
            own.add_argument(flag, **how | {"default": argparse.SUPPRESS})  # before or after the command
        for flag, how in options:
            own.add_argument(flag, **how)

    number, path, size = {"type": int}, {}, {"type": tx.parse_size}
    probe = ("--json-record-probe-size", size | {"default": fs.MAX_JSON})
    command("index", ("paths", {"nargs": "+"}), ("--chunk-size", number | {"default": 800}), ("--overlap", number | {"default": 100}), ("--force", {"action": "store_true"}), ("--json-config", path),
            ("--exclude-dir", {"action": "append", "default": []}), ("--exclude-file", {"action": "append", "default": []}), ("--max-files", number | {"default": 0}), ("--max-json-size", size | {"default": fs.MAX_JSON}), probe)
    command("search", ("query", {}), ("--limit", number | {"default": 10}), ("--type", {"choices": KINDS}), ("--path", path), ("--no-color", {"action": "store_true"}))
    command("ask", ("question", {}), ("--rag-config", path), ("--top-k", number), ("--max-context-chars", number), ("--temperature", {"type": float}))
    command("eval", ("cases", {}), ("--rag-config", path), ("--records", {"default": "logs/eval.log"}), ("--cleaned", {"default": "cleaned.jsonl"}), ("--report", {"default": "report.md"}))
    for name in ("stats", "list", "prune", "check-db", "init-db"):
        command(name)
    command("remove", ("path", {}))
    command("json-preview", ("path", {}), ("--json-config", {"required": True}), ("--limit", number | {"default": 5}), ("--max-json-size", size | {"default": 0}), probe)
    command("json-structure", ("path", {}), ("--max-records", number | {"default": json_records.MAX_RECORDS}), ("--read-size", number | {"default": 1 << 16}), ("--max-depth", number | {"default": json_records.MAX_DEPTH}),
            ("--max-paths", number | {"default": json_records.MAX_PATHS}), ("--max-json-size", size | {"default": 0}), probe)
    return top


def json_file(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The file as path and text, read by a task and not here."""
    if args.max_json_size and os.path.getsize(args.path) > args.max_json_size:
        raise ValueError(f"{args.path} is larger than {args.max_json_size} bytes")
    found = fs.scan(spark, [os.path.realpath(args.path)], max_json=0).withColumn("r", fs.read_text("content", F.lit("json")))
    return found.select("path", "r.text", "r.error")


def run(args: argparse.Namespace, spark: SparkSession, client: answers.Client | None = None) -> int:
    store = Store(spark, args.db if "://" in args.db else f"file://{os.path.abspath(args.db)}")
    known = settings()
    secrets = {"key": known.get(KEY, ""), "url": known.get(URL, "")}

    def model(messages: list[dict[str, str]], temperature: float) -> dict:
        """The client is made when the model is first needed, so that a refusal needs no settings."""
        return (client or HttpClient.from_settings(known))(messages, temperature)

    def rag(**overrides) -> answers.Settings:
        given = {k: v for k, v in overrides.items() if v is not None}
        return answers.Settings.from_file(args.rag_config, **given) if args.rag_config else answers.Settings(**given)

    if args.command == "index":
        profile = json_records.Profile.from_file(args.json_config) if args.json_config else None
        unread = [*args.exclude_file, *([args.json_config] if args.json_config else [])]
        stats = store.index(args.paths, profile=profile, size=args.chunk_size, overlap=args.overlap, force=args.force, exclude_dirs=args.exclude_dir, exclude_files=unread, max_files=args.max_files, max_json=args.max_json_size, probe=args.json_record_probe_size)
        print(stats)
        return int(stats["failed"] + stats["oversized"] > 0 and stats["indexed"] == 0)
    if args.command == "search":
        marks = ("\x1b[1;33m", "\x1b[0m") if sys.stdout.isatty() and not args.no_color else ("[[", "]]")
        for r in search(store.read(), {0: args.query}, limit=args.limit, file_type=args.type, path=args.path).withColumn("shown", tx.highlight(F.col("content"), args.query, *marks)).orderBy("rank").collect():
            print(f"{r['rank']}. {r['path']} #{r['chunk_index']} {r['score']:.6f}\n{r['shown']}")
    elif args.command == "ask":
        record = answers.ask(store.read(), args.question, model, rag(top_k=args.top_k, max_context_chars=args.max_context_chars, temperature=args.temperature), audit=answers.audit_table(args.log_file), **secrets)
        print(record["answer"])
        for c in record["retrieval_results"]:
            print(f"[{c['citation_id']}] {c['filename']}，分段 {'、'.join(map(str, c['chunk_indexes']))}")
    elif args.command == "eval":
        cases = evaluation.cases(spark, args.cases)
        scores = evaluation.scored(cases, evaluation.run(store.read(), cases, args.records, model, rag(), **secrets))
        evaluation.write_cleaned(scores, args.cleaned)
        with open(args.report, "w", encoding="utf-8") as file:
            file.write(evaluation.report(scores))
        return int(not scores.where("NOT passed").isEmpty())
    elif args.command == "init-db":
        if not store.version():
            empty = store.read()
            store.commit(empty.documents, empty.chunks)
    elif args.command == "stats":
        health.counts(store.read()).show(truncate=False)
    elif args.command == "list":
        now = store.read()
        for r in health.listed(now.documents, now.chunks).select("path", "file_type", "chunk_count").orderBy("path").toLocalIterator():
            print(f"{r['path']}\t{r['file_type']}\t{r['chunk_count']}")
    elif args.command == "remove":
        return int(not store.remove(args.path))
    elif args.command == "prune":
        there = F.udf(os.path.exists, "boolean")  # this machine's files, as in `index`
        print(store.prune(store.read().documents.select("path").where(there("path"))))
    elif args.command == "check-db":
        found = health.issues(store.read()).collect()  # a row for each rule
        print("\n".join(f"{r['rule']}: {r['n']}" for r in found) or "healthy")
        return int(bool(found))
    else:
        file = json_file(spark, args)
        whole = json_records.Profile.from_file(args.json_config) if args.command == "json-preview" else json_records.Profile.from_config({"fields": ["$"]})
        rows = json_records.extracted(file, whole, args.json_record_probe_size, raw=False)
        if args.command == "json-preview":
            for r in json_records.preview(file, whole, args.limit, args.json_record_probe_size).collect():
                print(r["text"])
        else:
            report, n, complete = json_records.structure_report(json_records.raw_records(file, args.json_record_probe_size), "text", order="record_no", max_records=args.max_records, max_depth=args.max_depth, max_paths=args.max_paths)
            print(json.dumps({"records": n, "complete": complete}))
            for r in report.orderBy("path", "kind").toLocalIterator():
                print(f"{r['path']}\t{r['kind']}\t{r['n']}")
        fault = rows.where("error IS NOT NULL").select("error").first() or file.where("error IS NOT NULL").select("error").first()
        if fault:
            raise ValueError(fault[0])
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("skein").getOrCreate()
    try:
        return run(args, spark)
    except (OSError, ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
