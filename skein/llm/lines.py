"""Operator 2, line dedup over sharded minimal perfect hashes.

A line's key is the line without ASCII white space at both ends, with A-Z lower-cased. Keys of at least `min_chars` code
points found in at least `min_docs` documents lose all their lines except in the largest identifier holding them.

Each document's distinct key hashes (128 bits) are counted, with partial sums before the shuffle, so a line that a
third of all documents hold is one row a task. Distinct hashes found more than once are dealt to shards by hash; a shard is
a minimal perfect hash (levels of bit arrays in which each key finds a place of its own, and a running count of bits) that
numbers its n keys from 0 to n-1, and three arrays in that order: a fingerprint of 64 bits, in how many documents the line
is, and the largest identifier. Documents never join lines: a task hashes its lines, sorts the hashes by shard and probes
each shard's arrays once for up to `PROBE_BYTES` of texts, keeping up to `CACHED_SHARDS` for the next ones; a line goes if
its count reaches `min_docs`. The fingerprint turns away lines that no shard holds, so with the hash's other 64 bits a wrong
hit takes a collision of 128 bits. Shards hold at most about `SHARD_KEYS` keys, so a task's memory is bounded however many
lines repeat; what grows with the corpus is that each task reads all shards, one at a time.

Cases: a null or empty text is one empty line, kept as it is (null stays null); a very long line is hashed whole; a null
identifier counts as a document of its own but is never the largest; rows sharing an identifier are one document to the
count, and keep or lose lines alike; an empty table gives no rows; extra columns are carried whatever their names, except
that n_lines and n_dropped replace such names.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, carrying, shared_dir, sized, small, table
from .sstable import load_arrays, save_arrays

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 20
PROBE_BYTES, CACHED_SHARDS = 64 << 20, 4
WHITE = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: str) -> bytes:
    return line.strip(WHITE).encode().lower()  # of bytes, lower() changes A-Z only


def key_hash(line: str, min_chars: int) -> int | None:
    """128 bits of the line's key, or None where it is too short to count."""
    bare = line.strip(WHITE)
    return xxhash.xxh3_128_intdigest(bare.encode().lower()) if len(bare) >= min_chars else None


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers n distinct 64-bit keys from 0 to n-1; other keys get any number or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.starts = np.cumsum([0, *sizes])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.7, levels: int = 40) -> PerfectHash:
        sizes, parts, left = [], [], keys
        for level in range(levels):
            if not len(left):
                break
            size = max(64, -(-int(room * len(left)) // 64) * 64)
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, "<u8"), np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[own]] = (self.before[word] + below)[own]
            open_ = open_[~own]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, keys[open_])
            hit = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_])
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


def save_shard(path: str, low: np.ndarray, high: np.ndarray, docs: np.ndarray, largest: np.ndarray) -> None:
    ph = PerfectHash.build(low)
    order = np.empty(len(low), np.int64)
    order[ph.find(low)] = np.arange(len(low))
    save_arrays(path, [ph.sizes, ph.words, ph.rest, high[order], np.minimum(docs[order], (1 << 32) - 1).astype("<u4"), largest[order]])


class Shard:
    def __init__(self, path: str):
        *own, self.fingerprints, self.docs, self.largest = load_arrays(path, "qQQQIq")
        self.hash = PerfectHash(*own)

    def probe(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many documents each hash is known to be (0 for one not held), and the largest identifier there."""
        at = self.hash.find(low)
        hit = at >= 0
        hit[hit] = self.fingerprints[at[hit]] == high[hit]
        docs, largest = np.zeros(len(low), np.int64), np.full(len(low), NO_ID, np.int64)
        docs[hit], largest[hit] = self.docs[at[hit]], self.largest[at[hit]]
        return docs, largest


def build_index(docs: DataFrame, folder: str, *, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> list[str]:
    """Writes the shards; returns their paths by shard number, '' for a shard without keys."""
    scratch = Scratch()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a batch first add up in the worker."""
        for b in small(batches, 2048):
            found: dict[int, list[int]] = {}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = NO_ID if doc_id is None else doc_id
                for h in {key_hash(x, min_chars) for x in text.split("\n")} - {None} if text else ():
                    if (row := found.get(h)) is None:
                        found[h] = [1, own]
                    else:
                        row[0] += 1
                        row[1] = max(row[1], own)
            raw = np.frombuffer(b"".join([h.to_bytes(16, "little") for h in found]), "<i8").reshape(-1, 2)
            sums = np.array(list(found.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (raw[:, 0], raw[:, 1], sums[:, 0], sums[:, 1])], ["low", "high", "n", "largest"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row's distinct hashes with its identifier."""
        for b in small(batches, 2048):
            rows = [(h, i) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h in {key_hash(x, min_chars) for x in (text or "").split("\n")} - {None}]
            raw = np.frombuffer(b"".join([h.to_bytes(16, "little") for h, _ in rows]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(raw[:, 0])), pa.array(np.ascontiguousarray(raw[:, 1])), pa.array([i for _, i in rows], pa.int64())], ["low", "high", "doc_id"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "low long, high long, n long, largest long"
    shared = scratch(own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared")
    if shared.limit(1).count():  # lines of rows that are one document count once
        rows = own.join(shared, "doc_id", "left_semi").mapInArrow(each, "low long, high long, doc_id long").distinct()
        again = rows.select("low", "high", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("largest"))
        found = own.join(shared, "doc_id", "left_anti").mapInArrow(hashes, kinds).unionByName(again)
    else:
        found = own.mapInArrow(hashes, kinds)
    counted = scratch(found.groupBy("low", "high").agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).where("n > 1"), "repeated")
    shards = max(1, -(-counted.count() // shard_keys))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]  # one shard: at most about shard_keys rows
        if rows:
            t = pa.Table.from_batches(rows)
            low, high, n, largest = (t.column(k).to_numpy() for k in range(4))
            shard = int(low.view("<u8")[0] % np.uint64(shards))
            save_shard(f"{folder}/{shard:06d}.mph", low.view("<u8"), high.view("<u8"), n, largest)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    number = F.expr(f"cast(pmod(pmod(low, {shards}) + if(low < 0, {(1 << 64) % shards}, 0), {shards}) as int)")  # low as unsigned, modulo
    made = {r[0] for r in counted.repartitionById(shards, number).mapInArrow(build, "shard int").collect()}
    scratch.clear()
    return [f"{folder}/{k:06d}.mph" if k in made else "" for k in range(shards)]


def drop_lines(docs: DataFrame, shards: list[str], *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with repeated lines dropped from `text`, n_lines (before) and n_dropped."""
    return carrying(docs, lambda own: _dropped(own, shards, min_chars, min_docs))


def _dropped(docs: DataFrame, shards: list[str], min_chars: int, min_docs: int) -> DataFrame:
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    last: OrderedDict[str, Shard] = OrderedDict()

    def loaded(path: str) -> Shard:
        if path not in last:
            while len(last) >= CACHED_SHARDS:
                last.popitem(last=False)
            last[path] = Shard(path)
        last.move_to_end(path)
        return last[path]

    def hashed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, line and 128-bit hash of the lines that are long enough; lines themselves are not held."""
        rows, places, keys = [], [], []
        for row, text in enumerate(b.column(1).to_pylist()):
            for k, line in enumerate(text.split("\n") if text else ()):
                if len(line) >= min_chars and (h := key_hash(line, min_chars)) is not None:
                    rows.append(row)
                    places.append(k)
                    keys.append(h.to_bytes(16, "little"))
        return np.array(rows, np.int64), np.array(places, np.int64), np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)

    def resolve(held: list[pa.RecordBatch], found: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(f[0]) for f in found]
        raw, gone = np.concatenate([f[2] for f in found]), np.zeros(sum(sizes), bool)
        own_ids = np.concatenate([np.array([NO_ID if i is None else i for i in b.column(0).cast(pa.int64()).to_pylist()], np.int64)[f[0]] for b, f in zip(held, found, strict=True)])
        low, high = np.ascontiguousarray(raw[:, 0]), np.ascontiguousarray(raw[:, 1])
        shard = (low % np.uint64(len(shards))).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
            if path := shards[int(shard[own[0]])]:
                docs_, largest = loaded(path).probe(low[own], high[own])
                gone[own] = (docs_ >= min_docs) & ((own_ids[own] == NO_ID) | (own_ids[own] != largest))
        for b, (rows, places, _), out in zip(held, found, np.split(gone, np.cumsum(sizes)[:-1]), strict=True):
            drop: dict[int, set[int]] = defaultdict(set)
            for row, k in zip(rows[out].tolist(), places[out].tolist(), strict=True):
                drop[row].add(k)
            texts = b.column(1).to_pylist()
            lines = np.array([t.count("\n") + 1 if t else 1 for t in texts], np.int64)
            for row, at in drop.items():
                texts[row] = "\n".join([x for k, x in enumerate(texts[row].split("\n")) if k not in at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[2:], pa.array(lines), pa.array([len(drop.get(k, ())) for k in range(len(texts))], pa.int64())], schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches and their hashes are gathered up to a bound, so that each shard is loaded once for many documents."""
        held, found, size = [], [], 0
        for b in sized(batches, 1, rows=1024, size=PROBE_BYTES // 8):
            held.append(b)
            found.append(hashed(b))
            size += pc.sum(pc.fill_null(pc.binary_length(b.column(1)), 0)).as_py()
            if size > PROBE_BYTES:
                yield from resolve(held, found)
                held, found, size = [], [], 0
        if held:
            yield from resolve(held, found)

    return docs.mapInArrow(work, schema)


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    if min_docs < 2:
        raise ValueError("lines must be in two documents at least to be dropped")
    bound_batches(docs.sparkSession)
    folder = shared_dir(docs.sparkSession, "lines")
    return drop_lines(docs, build_index(docs, folder, min_chars=min_chars, shard_keys=shard_keys), min_chars=min_chars, min_docs=min_docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, CAST(u.i AS BIGINT) AS i, u.line, translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) u
), repeated AS (
  SELECT k, max(doc_id) AS largest FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE r.k IS NOT NULL AND l.doc_id <> r.largest) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE r.k IS NULL OR l.doc_id = r.largest), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r ON l.k = r.k GROUP BY l.doc_id
"""
