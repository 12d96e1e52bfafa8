"""JSON records: fields to text, filters, preview and a report of their structure."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonpath as jp

MAX_RECORDS, MAX_DEPTH, MAX_PATHS = 100, 20, 10_000
BLOCK_CHARS = 64 << 10


@dataclass(frozen=True)
class Profile:
    """What of a JSON file becomes text."""

    fields: list[tuple[str, str, str]]  # name, path, joiner
    name: str = ""
    record_path: str = "$"
    index_mode: str = "record"
    separator: str = "\n"
    rules: list[tuple] = field(default_factory=list)
    fingerprint: str = ""

    @classmethod
    def from_config(cls, config: dict) -> Profile:
        mode = config.get("index_mode", "record")
        if mode not in ("record", "file"):
            raise ValueError("index_mode is 'record' or 'file'")
        listed = config.get("fields")
        if not isinstance(listed, list) or not listed:
            raise ValueError("fields is a list with items")
        fields = [("", f, "、") if isinstance(f, str) else (f.get("name", ""), f["path"], f.get("join", "、")) for f in listed]
        rules = config.get("filter") or []
        rules = [jp.check_rule(r) for r in (rules if isinstance(rules, list) else [rules])]
        record_path = config.get("record_path", "$")
        jp.parse(record_path)
        for path in [p for _, p, _ in fields] + [r[0] for r in rules]:
            jp.parse(path)
            if path.startswith("$") and record_path != "$":
                raise ValueError("paths from the root need record_path '$'")
        canonical = json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return cls(fields, config.get("name", ""), record_path, mode, config.get("separator", "\n"), rules, hashlib.sha256(canonical.encode()).hexdigest())

    @classmethod
    def from_file(cls, path: str) -> Profile:
        with open(path, encoding="utf-8-sig") as file:
            return cls.from_config(json.load(file))


def record_text(record, profile: Profile) -> str:
    parts = []
    for name, path, joiner in profile.fields:
        text = jp.texts(jp.resolve(record, jp.parse(path)), joiner)
        parts.append(f"{name}: {text}" if name and text else text)
    return profile.separator.join(p for p in parts if p)


BLANK = re.compile(r"[ \t\r\n]*")
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
NESTING = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)
SCALAR = re.compile(r"-?[0-9][0-9.eE+-]*|true|false|null")


class Scanner:
    """Places of JSON values in a text, found by their brackets and strings alone, so that only what is asked for is parsed."""

    def __init__(self, text: str):
        self.text = text

    def blank(self, at: int) -> int:
        return BLANK.match(self.text, at).end()

    def sign(self, at: int) -> str:
        return self.text[at : at + 1]

    def fault(self, at: int) -> ValueError:
        return ValueError(f"no JSON at {at}" if at < len(self.text) else "the JSON ends too early")

    def end(self, at: int) -> int:
        """Where the value that starts here ends."""
        if self.sign(at) not in ("[", "{"):
            m = (STRING if self.sign(at) == '"' else SCALAR).match(self.text, at)
            if not m:
                raise self.fault(at)
            return m.end()
        open_: list[str] = []
        for m in NESTING.finditer(self.text, at):
            sign = m[0]
            if sign in ("[", "{"):
                open_.append("]" if sign == "[" else "}")
            elif sign in ("]", "}"):
                if open_.pop() != sign:
                    raise self.fault(m.start())
                if not open_:
                    return m.end()
        raise self.fault(len(self.text))

    def inside(self, at: int) -> Iterator[tuple[str | None, int, int]]:
        """(name or None, start, end) of what an object or array holds; then (None, -1, its end)."""
        close = "]" if self.sign(at) == "[" else "}"
        at = self.blank(at + 1)
        if self.sign(at) == close:
            yield None, -1, at + 1
            return
        while True:
            name = None
            if close == "}":
                m = STRING.match(self.text, at)
                if not m or self.sign(colon := self.blank(m.end())) != ":":
                    raise self.fault(at)
                name, at = json.loads(m[0]), self.blank(colon + 1)
            end = self.end(at)
            yield name, at, end
            at = self.blank(end)
            if self.sign(at) == close:
                yield None, -1, at + 1
                return
            if self.sign(at) != ",":
                raise self.fault(at)
            at = self.blank(at + 1)

    def follow(self, at: int, steps: tuple) -> Iterator[tuple[int, int]]:
        """Places that the steps lead to from the value here. A scalar where a container is asked for, and a number asked of
        an object, are errors; a name asked of an array finds nothing."""
        if not steps:
            yield at, self.end(at)
            return
        kind, step = self.sign(at), steps[0]
        if kind not in ("[", "{") or kind == "{" and isinstance(step, int):
            raise ValueError("record_path leads nowhere in a record")
        if kind == "[" and isinstance(step, str):
            return
        for n, (name, low, _) in enumerate(self.inside(at)):
            if low >= 0 and (step is ... or step == (name if kind == "{" else n)):
                yield from self.follow(low, steps[1:])


def record_places(text: str, record_path: str = "$") -> Iterator[tuple[int, int]]:
    """Start and end of each record: those of an array's items, else of one value after another, record_path followed inside
    each. Records before a fault are yielded first."""
    scan, steps, at = Scanner(text), jp.parse(record_path), 0
    at = scan.blank(at)
    if scan.sign(at) == "[":
        for _, low, high in scan.inside(at):
            if low >= 0:
                yield from scan.follow(low, steps)
            elif scan.blank(high) < len(text):
                raise ValueError("something follows the array")
        return
    while at < len(text):
        yield from scan.follow(at, steps)
        at = scan.blank(scan.end(at))


def file_records(text: str, record_path: str = "$") -> Iterator:
    """Records of a file, parsed one by one."""
    text = text.removeprefix("\ufeff")
    return (json.loads(text[low:high]) for low, high in record_places(text, record_path))


OUT = {"path": pa.string(), "record_no": pa.int64(), "block_no": pa.int32(), "text": pa.string(), "error": pa.string()}


def extracted(files: DataFrame, profile: Profile, probe_bytes: int = 512 << 20, raw: bool = True) -> DataFrame:
    """files: path, text. A row a record that passes: path, record_no, block_no, text, error (null unless the file
    failed there). A record of more bytes than the probe comes as it stands in the file, in blocks, without fields or
    filters, or as an error if not `raw`."""

    def of_file(path: str, text: str) -> Iterator[tuple]:
        wanted, n = jp.predicate(profile.rules), -1
        try:
            for n, (low, high) in enumerate(record_places(text, profile.record_path)):
                if 4 * (high - low) > probe_bytes and len(text[low:high].encode()) > probe_bytes:
                    if not raw:
                        raise ValueError(f"record {n} is longer than {probe_bytes} bytes")
                    yield from ((path, n, k, text[s : min(s + BLOCK_CHARS, high)], None) for k, s in enumerate(range(low, high, BLOCK_CHARS)))
                elif wanted(record := json.loads(text[low:high])) and (out := record_text(record, profile)):
                    yield path, n, 0, out, None
        except ValueError as e:
            yield path, n + 1, 0, None, str(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for k in range(b.num_rows) for row in of_file(b.column(0)[k].as_py(), (b.column(1)[k].as_py() or "").removeprefix("\ufeff")))
        while some := list(itertools.islice(rows, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), OUT.values(), strict=True)], list(OUT))

    return files.select("path", "text").mapInArrow(work, "path string, record_no long, block_no int, text string, error string")


def raw_records(files: DataFrame, probe_bytes: int = 512 << 20) -> DataFrame:
    """record_no and text, as it stands in the file, of every record up to a fault or one longer than the probe."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in (t.removeprefix("\ufeff") for b in batches for t in b.column(0).to_pylist() if t):
            with contextlib.suppress(ValueError):
                for n, (low, high) in enumerate(record_places(text)):
                    if len(text[low:high].encode()) > probe_bytes:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([text[low:high]])], ["record_no", "text"])

    return files.select("text").mapInArrow(work, "record_no long, text string")


def preview(files: DataFrame, profile: Profile, limit: int = 5, probe_bytes: int = 512 << 20) -> DataFrame:
    """The first records by file and place; with index_mode 'file' the first records of each file as one text."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    found = extracted(files, profile, probe_bytes, raw=False).where("error IS NULL").orderBy("path", "record_no").limit(limit)
    if profile.index_mode == "record":
        return found
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("record_no", "text"))), lambda r: r["text"])  # `limit` rows
    return found.groupBy("path").agg(F.lit(0).cast("long").alias("record_no"), F.lit(0).alias("block_no"), F.array_join(in_order, profile.separator).alias("text"), F.lit(None).cast("string").alias("error"))


def field_texts(records: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Fast path for plain fields: one VARIANT per record, one text per path; missing and null give the empty string."""
    parsed = F.try_parse_json(F.col(column))
    df = records.withColumn("_v", parsed)
    return df.withColumns({n: F.coalesce(F.try_variant_get("_v", p, "string"), F.lit("")) for n, p in paths.items()}).drop("_v")


def where_json(column: Column, rules: list[dict]) -> Column:
    """Fast path for filters on single values: strings, numbers, booleans and existence."""
    v, out = F.try_parse_json(column), F.lit(True)
    for path, op, expected in map(jp.check_rule, rules):
        there = F.try_variant_get(v, path, "variant").isNotNull()

        def equal(x, path=path):
            kind = "boolean" if isinstance(x, bool) else "double" if isinstance(x, (int, float)) else "string"
            of_kind = F.schema_of_variant(F.try_variant_get(v, path, "variant")).isin(["BOOLEAN"] if kind == "boolean" else ["STRING"] if kind == "string" else ["BIGINT", "DOUBLE", "FLOAT"]) | F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("DECIMAL") & F.lit(kind == "double")
            return F.coalesce(of_kind & (F.try_variant_get(v, path, kind) == F.lit(float(x) if kind == "double" else x)), F.lit(False))

        if op == "exists":
            out &= there == F.lit(expected)
        elif op == "equals":
            out &= equal(expected)
        elif op == "not_equals":
            out &= there & ~equal(expected)
        else:
            any_of = F.lit(False)
            for x in expected:
                any_of |= equal(x)
            out &= any_of
    return out


def structure(records: DataFrame, column: str, *, order: str | None = None, max_records: int = 0, max_depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS) -> DataFrame:
    """path, kind, n over all records, or the first `max_records` of them, for the `max_paths` paths that are seen first,
    records in their `order` (as they are read, if there is none). Counts add up in the worker first."""
    own = records.select(F.col(column).cast("string").alias("_text"), (F.col(order) if order else F.monotonically_increasing_id()).cast("long").alias("_no"))
    if max_records:
        own = own.orderBy("_no").limit(max_records)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], list] = {}
            for text, no in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text) if text else ...
                except ValueError:
                    continue
                for place, key in enumerate(jp.visit(value, "$", max_depth) if value is not ... else ()):
                    if (row := found.get(key)) is None:
                        found[key] = [1, (no, place)]
                    else:
                        row[0] += 1
                        row[1] = min(row[1], (no, place))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), *(pa.array(x, pa.int64()) for x in ([r[0] for r in found.values()], [r[1][0] for r in found.values()], [r[1][1] for r in found.values()]))], ["path", "kind", "n", "no", "place"])

    counts = own.mapInArrow(work, "path string, kind string, n long, no long, place long").groupBy("path", "kind").agg(F.sum("n").alias("n"), F.min(F.struct("no", "place")).alias("first"))
    paths = counts.groupBy("path").agg(F.min("first").alias("first")).orderBy("first", "path").limit(max_paths).select("path")
    return counts.drop("first").join(F.broadcast(paths) if max_paths <= 100_000 else paths, "path", "left_semi")


def structure_report(records: DataFrame, column: str, *, max_records: int = MAX_RECORDS, **options) -> tuple[DataFrame, int, bool]:
    """`structure`, how many records it is of, and whether these are all there are. 0 is no limit."""
    seen = records.limit(max_records + 1).count() if max_records else records.count()
    complete = not max_records or seen <= max_records
    return structure(records, column, max_records=0 if complete else max_records, **options), min(seen, max_records or seen), complete
