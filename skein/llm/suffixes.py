"""Operator 10, suffix-array dedup of byte strings that occur twice or more.

Every byte covered by a `length`-byte string that also starts anywhere else is removed. Sorting all suffixes moves many
times the corpus; this is a sparse suffix array that loses none of them. Each window of `length` bytes picks, among the
strings of `length - choices + 1` bytes inside it, the leftmost with the smallest hash, its anchor. The choice depends on
the window's bytes alone, so equal windows share an anchor, and windows of one document with one anchor form a run. A run
stands for the suffix that starts at its first window, and its tokens are its anchor's hash (standing for its leading
bytes), the hash of all bytes its windows cover, the row and the place.

    deal      splitters sampled from documents cut the order of suffixes into ranges, one a partition. They are whole
              token tuples, so even one very common suffix is cut in the middle. Their number follows the corpus's bytes.
    sort      a partition sorts its suffixes by multikey quicksort: three-way by one token, then by the next.
    compare   neighbours with the same first two tokens are equal runs: all their windows recur. Runs that share just
              the anchor may agree in part; they, and all runs in a partition's first and last anchor, which may go
              on beyond it, are compared window by window: equal windows are counted across all partitions.

Runs of unlike anchors share no window. A partition holds about one run of 29 bytes for 33 bytes of text, of which it
gets `PART_BYTES` at most.

Passages. A second, shorter length may be asked for, whose repeats are measured and not removed. A maximal run of them with
more than `PASSAGE_WORDS` whole words is a passage (`PASSAGE` is 240 bytes, which hardly any fifty words fall short of).
The short repeats are found first, and the long ones only within them: a string recurs only where all shorter ones inside
it do, so the second search reads just stretches of repeated short windows.

Equality is of 128 bits of hash for runs (the two tokens) and of 96 for windows (two hashes, one of them cut to half). Hashes are prefix sums over scrambled 8-byte
strings, so that no pattern of bytes adds up to the same sum by its structure. Rows are told apart by 128 bits.

Cases: a null or empty text, and one shorter than `length`, loses nothing; a very long text is handled in blocks of windows
and held by one task; rows sharing an identifier are separate documents, so two equal rows of `length` bytes lose
everything; ties between equal anchors go to the leftmost; a null identifier is carried; an empty table gives no rows;
extra columns are carried by `cut_repeats` whatever their names, except that its own results replace such names.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, carrying, small, sound_key, staged, table, unstage, width_for
from .neardup import mix

LENGTH, CHOICES = 400, 65
PASSAGE, PASSAGE_WORDS = 240, 50
SAMPLE_RUNS = 200_000
PART_BYTES = 64 << 20
BLOCK, UNIT = 1 << 20, 8
U = np.uint64
RUN = np.dtype([("anchor", "<u8"), ("body", "<u8"), ("row", "<i8"), ("start", "<u4"), ("n", "u1")])
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers can be divided out
REGIONS = "array<struct<start:int,end:int>>"


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2^64 and of its inverse, n of them at least."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size, base = 1 << max(15, (n - 1).bit_length()), BASES[which]
        back = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[which] = tuple(np.concatenate([[U(1)], np.cumprod(np.full(size - 1, b, U), dtype=U)]) for b in (base, back))
    return _POWERS[which]


class Prefix:
    """Hashes of any substring of `UNIT` bytes or more in constant time each, from sums over its 8-byte strings, each
    scrambled, times powers."""

    def __init__(self, data: np.ndarray, which: int):
        n = max(0, len(data) - UNIT + 1)
        forth, self.back = powers(which, len(data) + 1)
        units = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(U) if n else np.zeros(0, U)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[U(0)], np.cumsum(mix(units + U(BASES[1 - which])) * forth[:n], dtype=U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end - (UNIT - 1)] - self.sums[start]) * self.back[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def run_tokens(data: np.ndarray, row: int, length: int = LENGTH, choices: int = CHOICES) -> np.ndarray:
    """The document's runs, ascending by start. Windows are handled in blocks, which bounds memory."""
    windows = len(data) - length + 1
    if windows < 1:
        return np.zeros(0, RUN)
    one, two, gram, out = Prefix(data, 0), Prefix(data, 1), length - choices + 1, []
    for low in range(0, windows, BLOCK):
        n = min(BLOCK, windows - low)
        at = np.arange(low, low + n + choices - 1)
        grams = one.of(at, at + gram)
        # place in the low bits: among equal grams the leftmost is least
        value = grams & U(~((BLOCK << 1) - 1) & (1 << 64) - 1) | (at - low).astype(U)
        least, span = value, 1
        while 2 * span <= choices:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < choices:
            least = np.minimum(least[: len(least) - (choices - span)], least[choices - span :])
        place = (least & U((BLOCK << 1) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        runs = np.zeros(len(first), RUN)
        runs["anchor"], runs["row"], runs["start"], runs["n"] = grams[place[first]], row, low + first, last - first + 1
        with np.errstate(over="ignore"):
            runs["body"] = two.of(low + first, low + last + length) + (place[first] - first).astype(U)
        out.append(runs)
    return np.concatenate(out)


def region_runs(text: str | None, regions: list[dict] | None, row: int, length: int, choices: int) -> np.ndarray:
    """Runs of a text's regions, or of all of it where regions are null."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    out = []
    for low, high in [(0, len(data))] if regions is None else [(r["start"], r["end"]) for r in regions]:
        runs = run_tokens(data[low:high], row, length, choices)
        runs["start"] += low
        out.append(runs)
    return np.concatenate(out) if out else np.zeros(0, RUN)


def part_of(runs: np.ndarray, splitters: list[tuple]) -> np.ndarray:
    """Which range each run is in."""
    leads = np.array([s[0] for s in splitters], U)
    left, out = np.searchsorted(leads, runs["anchor"], "left"), np.searchsorted(leads, runs["anchor"], "right")
    for k in np.flatnonzero(left != out):  # the anchor is a splitter's: later tokens decide
        r = runs[k]
        out[k] = bisect_right(splitters, (int(r["anchor"]), int(r["body"]), int(r["row"]), int(r["start"])))
    return out


def multikey_order(columns: list[np.ndarray], small_range: int = 1 << 15) -> np.ndarray:
    """Indices that sort rows by the columns in turn: multikey quicksort, three-way by a pivot of one column; rows equal
    to it are sorted by the next. Short ranges are sorted at once."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(columns[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if not len(rows):
            continue
        if depth == len(columns) or len(rows) <= small_range:
            out.append(rows[np.lexsort([c[rows] for c in columns[:depth - 1 if depth else None:-1]])] if depth < len(columns) else rows)
            continue
        key = columns[depth][rows]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4 if len(key) >= 9 else 0]
        below, above = key < pivot, key > pivot
        todo += [(rows[above], depth), (rows[~below & ~above], depth + 1), (rows[below], depth)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def compare(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a partition's sorted runs: those whose windows all recur, those to compare by window, and what each of the
    latter weighs there (2 for one that stands for several equal runs)."""
    none = runs[:0]
    if not len(runs):
        return none, none, np.zeros(0, np.uint8)
    new_anchor = np.concatenate([[True], runs["anchor"][1:] != runs["anchor"][:-1]])
    new_class = new_anchor | np.concatenate([[True], runs["body"][1:] != runs["body"][:-1]]) | np.concatenate([[True], runs["n"][1:] != runs["n"][:-1]])
    group, class_ = np.cumsum(new_anchor) - 1, np.cumsum(new_class) - 1
    size = np.bincount(class_)
    repeated = size[class_] > 1
    classes_of = np.bincount(group[new_class])
    edge = (group == 0) | (group == group[-1])
    asked = (classes_of[group] > 1) | edge
    speaks = asked & new_class  # one for each class
    return runs[repeated], runs[speaks], np.where(repeated[speaks], 2, 1).astype(np.uint8)


def hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns({"_row": F.xxhash64(F.col("doc_id").cast("long"), text), "_check": F.xxhash64(text, F.col("doc_id").cast("long"))})


def row_splitters(docs: DataFrame, rows: int, parts: int, length: int, choices: int) -> list[tuple]:
    """Token tuples that cut a sample of suffixes evenly. They decide balance alone, never results."""
    share = min(1.0, max(200.0, parts * 8.0) / max(rows, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text, regions in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs = region_runs(text, regions, row, length, choices)
                runs = runs[:: max(1, len(runs) // 64)]
                yield pa.RecordBatch.from_arrays([pa.array(runs[c].astype(np.int64)) for c in ("anchor", "body", "row", "start")], ["anchor", "body", "row", "start"])

    found = docs.sample(share, seed=3).mapInArrow(work, "anchor long, body long, row long, start long").limit(SAMPLE_RUNS).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    tuples = sorted((unsigned(r[0]), unsigned(r[1]), r[2], r[3]) for r in found)
    return sorted({tuples[k * len(tuples) // parts] for k in range(1, parts)}) if tuples else []


def repeated_windows(docs: DataFrame, rows: int, size: int, *, length: int = LENGTH, choices: int = CHOICES) -> DataFrame:
    """_row, start, n: runs of window starts whose windows occur elsewhere too, as a staged table. docs: _row, text,
    regions (of bytes that count; null for all); about `rows` of them with `size` bytes."""
    if length - choices + 1 < UNIT:
        raise ValueError(f"the length must be {UNIT - 1} above the choices at least")
    spark, scratch = docs.sparkSession, Scratch()
    docs = docs.select("_row", "text", "regions")
    splitters = row_splitters(docs, rows, width_for(spark, size, PART_BYTES), length, choices)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            runs = np.concatenate(held)
            part = part_of(runs, splitters)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            blocks = np.split(runs[order], cut)
            return pa.RecordBatch.from_arrays([pa.array(part[order][[0, *cut]].astype(np.int32)), pa.array([x.tobytes() for x in blocks], pa.binary())], ["part", "runs"])

        for b in small(batches):
            for row, text, regions in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text and len(runs := region_runs(text, regions, row, length, choices)):
                    held.append(runs)
                    size += len(runs)
            if size > 300_000:
                yield dealt()
                held.clear()
                size = 0
        if held:
            yield dealt()

    dealt = docs.mapInArrow(runs_of, "part int, runs binary").repartitionById(len(splitters) + 1, F.col("part"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [np.frombuffer(x.as_buffer(), RUN) for b in batches for x in b.column(1)]
        if not data:
            return
        runs = np.concatenate(data)
        del data
        runs = runs[multikey_order([runs["anchor"], runs["body"], runs["row"], runs["start"]])]
        whole, asked, weight = compare(runs)
        for found, w in ((whole, np.zeros(len(whole), np.uint8)), (asked, weight)):
            for at in range(0, len(found), 50_000):
                x = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x["row"]), pa.array(x["start"].astype(np.int32)), pa.array(x["n"].astype(np.int32)), pa.array(w[at : at + 50_000].astype(np.int32))], ["_row", "start", "n", "weight"])

    compared = scratch(dealt.mapInArrow(sort, "_row long, start int, n int, weight int"), "runs")
    release(spark)
    whole = compared.where("weight = 0").select("_row", "start", "n")
    asked = compared.where("weight > 0").groupBy("_row").agg(F.collect_list(F.struct("start", "n", "weight")).alias("asked"))  # runs of one text

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for row, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                start = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs])
                weight = np.concatenate([np.full(r["n"], r["weight"]) for r in runs])
                one, two = (Prefix(data, k).of(start, start + length) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> U(32)).astype(np.uint32).view(np.int32)), pa.array(np.full(len(start), row)), pa.array(start.astype(np.int32)), pa.array(weight.astype(np.int32))], ["one", "two", "_row", "start", "weight"])

    explicit = scratch(docs.select("_row", "text").where(F.length("text") > 0).join(asked, "_row").select("_row", "text", "asked").mapInArrow(windows, "one long, two int, _row long, start int, weight int"), "windows")
    release(spark)
    again = explicit.groupBy("one", "two").agg(F.sum("weight").alias("total")).where("total > 1").select("one", "two")
    hits = explicit.where("weight = 1").join(again, ["one", "two"]).select("_row", "start", F.lit(1).alias("n"))
    found = staged(whole.unionByName(hits), "repeats")
    scratch.clear()
    release(spark)
    return found


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more; it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def merged(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte spans that the runs' windows cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words between white space that stand wholly in data[start:end]."""
    n = len(data[start:end].split())
    cut = lambda at: 0 < at < len(data) and not data[at - 1 : at].isspace() and not data[at : at + 1].isspace()
    return max(0, n - cut(start) - cut(end))


def joined_runs(found: DataFrame) -> DataFrame:
    """_row, runs: each row's runs of window starts, those that touch joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
        for b in small(batches):
            runs = [[{"start": a, "n": e - a} for a, e in merged(x, 1)] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind)], ["_row", "runs"])

    listed = found.groupBy("_row").agg(F.collect_list(F.struct("start", "n")))  # runs of one text
    return listed.mapInArrow(work, "_row long, runs array<struct<start:int,n:int>>")


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, choices: int = CHOICES, passage: int | None = None) -> DataFrame:
    """`docs` without `text` and with kept (binary: the remaining bytes), n_bytes, n_removed, n_spans. With `passage`, a
    length below `length`, also n_passage_bytes and n_passages: bytes in passages, and how many there are."""
    return carrying(docs, lambda own: _cut(own, length, choices, passage)).drop("text")


def _cut(docs: DataFrame, length: int, choices: int, passage: int | None) -> DataFrame:
    if passage is not None and not passage < length:
        raise ValueError("the passage length must be below the length")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    row = sound_key(hashed(docs.select("doc_id", "text")).select("_row", "_check"), "_row", "_check")
    docs = hashed(docs).withColumn("_row", row).drop("_check")
    first = repeated_windows(docs.withColumn("regions", F.lit(None).cast(REGIONS)), rows, size or 0, length=passage or length, choices=choices)
    short = staged(joined_runs(first), "short")  # the result reads it
    long_ = short
    if passage is not None:
        least = length - passage + 1  # so many starts of short repeats in a row make a stretch of `length` bytes
        regions = F.transform(F.filter("runs", lambda r: r["n"] >= least), lambda r: F.struct(r["start"].alias("start"), (r["start"] + r["n"] + (passage - 1)).alias("end")))
        stretches = docs.select("_row", "text").join(short.select("_row", regions.alias("regions")).where(F.size("regions") > 0), "_row")
        inside = staged(stretches.select("_row", "text", "regions"), "stretches")
        second = repeated_windows(inside, *inside.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first(), length=length, choices=choices)
        long_ = staged(joined_runs(second), "long")  # the result reads it
        for done in (inside, second):
            unstage(done)
    unstage(first)
    release(docs.sparkSession)

    new = {"kept": T.BinaryType()} | {n: T.LongType() for n in ("n_bytes", "n_removed", "n_spans", *(("n_passage_bytes", "n_passages") if passage else ()))}
    carried = [f for f in docs.schema.fields if f.name not in ("text", "_row")]
    names = [*(f.name for f in carried), "text", *new]
    schema = T.StructType([*carried, T.StructField("text", T.StringType()), *(T.StructField(n, t) for n, t in new.items())])
    joined = docs.join(long_.withColumnRenamed("runs", "_long"), "_row", "left").join(short.withColumnRenamed("runs", "_short"), "_row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(carried)
        for b in small(batches):
            kept, numbers = [], []
            for text, runs, near in zip(*(b.column(k + c).to_pylist() for c in range(3)), strict=True):
                data, spans = (text or "").encode(), merged(runs or [], length)
                gaps = zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)], strict=True)
                kept.append(b"".join([data[s:e] for s, e in gaps]))
                wordy = [e - s for s, e in merged(near or [], passage) if whole_words(data, s, e) > PASSAGE_WORDS] if passage else []
                numbers.append((len(data), len(data) - len(kept[-1]), len(spans), sum(wordy), len(wordy)))
            counts = zip(*numbers, strict=True) if numbers else [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.nulls(b.num_rows, pa.string()), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in counts][: len(new) - 1]], names)

    return joined.select(*[F.col(f.name) for f in carried], "text", "_long", "_short").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs, passage=PASSAGE).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes", "n_passages")
