"""Operator 6, token-ID output as sorted-string-table shards.

A shard holds the documents of one range of identifiers, ascending. Its layout, all integers little-endian:

    block*   zlib of entries; an entry is varint shared, varint rest, `rest` key bytes, varint n_ids, ids.
             A key is the 8-byte big-endian identifier (sign flipped, so that bytes sort as numbers) and shares its
             first `shared` bytes with the key before it in the block. Ids take 2 bytes if the vocabulary has at most
             65,536 of them, else 4.
    index    for each block: first key 8, offset 8, stored size 4, entries 4, ids before it in the shard 8
    bloom    bits of a Bloom filter over the keys
    footer   FOOTER: offsets and sizes of index and bloom, probes, documents, ids, id width, magic

`lookup` reads the footer, the filter and the index, searches the index by bisection and reads one block.

Rows with a null identifier are in shards of their own after all others, dealt by their ids, with NULL_MAGIC in the
footer and an identifier of 0 in place of the missing one; readers give it back as null, and `lookup` of None finds them.

Cases: a null text is empty; a null identifier is carried; rows that share an identifier all stay, ordered by their
ids, which settles ties; a very long text is one entry and one block of its own; an empty table makes no shards; other
columns, whatever their names, are not stored.

Memory: a worker that encodes holds its cache of parts, an Arrow batch of about 8 MB and what is made of `ENCODED_BYTES` of it,
and hands the rest back as it goes. What is left then is the cache; writing adds a batch, a block and eight bytes a document.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, give_back, shared_dir, sized, width_for
from .tokens import load, segment_encoder, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 256 << 20
ENCODED_BYTES = 6 << 20  # text encoded at once; after twice as much, a worker hands free memory back
BLOOM_BITS, BLOOM_PROBES = 10, 7
MAGIC, NULL_MAGIC = b"SKEINSST", b"SKEINNUL"
FOOTER = struct.Struct("<QQQQIQQI8s")
INDEX = np.dtype([("key", ">u8"), ("offset", "<u8"), ("size", "<u4"), ("entries", "<u4"), ("before", "<u8")])


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def to_key(doc_id: int) -> bytes:
    return (doc_id + (1 << 63)).to_bytes(8, "big")


def from_key(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of each key, by double hashing."""
    with np.errstate(over="ignore"):
        a = keys * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(32)
        b = (keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD) | np.uint64(1)
        return (a[:, None] + np.arange(BLOOM_PROBES, dtype=np.uint64) * (b ^ (b >> np.uint64(29)))[:, None]) % np.uint64(bits)


class Writer:
    """Appends ascending documents to a binary stream; one block is held in memory."""

    def __init__(self, out, width: int, null: bool = False):
        self.out, self.width, self.null, self.at = out, width, null, 0
        self.block, self.entries, self.last, self.first = bytearray(), 0, b"", b""
        self.index: list[tuple] = []
        self.keys = array("Q")  # eight bytes a document, for the filter
        self.ids = self.before = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """`ids`: packed at the shard's width. A shard's identifiers are all null or none is."""
        key = to_key(0 if self.null else doc_id)
        if not self.entries:
            self.first, self.last, self.before = key, b"", self.ids
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        n = len(ids) // self.width
        self.block += varint(shared) + varint(8 - shared) + key[shared:] + varint(n) + ids
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + n
        self.keys.append(int.from_bytes(key, "big"))
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.entries:
            stored = zlib.compress(bytes(self.block), 1)
            self.index.append((int.from_bytes(self.first, "big"), self.at, len(stored), self.entries, self.before))
            self.out.write(stored)
            self.at += len(stored)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, INDEX).tobytes()
        bits = max(64, BLOOM_BITS * len(self.keys))
        keys, filter_ = np.frombuffer(self.keys, np.uint64) if self.keys else np.zeros(0, np.uint64), np.zeros(-(-bits // 8), np.uint8)
        for low in range(0, len(keys), 1 << 16):
            at = bloom_places(keys[low : low + (1 << 16)], bits).ravel()
            np.bitwise_or.at(filter_, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))  # as packbits has them
        bloom = filter_.tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), bits, BLOOM_PROBES, len(self.keys), self.ids, self.width, NULL_MAGIC if self.null else MAGIC))


class Reader:
    """A shard: footer, filter and index in memory, blocks read as asked for."""

    def __init__(self, path: str):
        self.file = open_input(path)
        size = self.file.size()
        raw = self.read(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, self.bits, _, self.documents, self.ids, self.width, magic = FOOTER.unpack(raw)
        if magic not in (MAGIC, NULL_MAGIC):
            raise ValueError(f"{path} is no shard")
        self.null = magic == NULL_MAGIC
        self.index = np.frombuffer(self.read(index_at, index_size), INDEX)
        self.firsts = self.index["key"].tolist()
        self.bloom = np.frombuffer(self.read(bloom_at, -(-self.bits // 8)), np.uint8)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """The block's documents with their ids."""
        row = self.index[k]
        data, at, key = zlib.decompress(self.read(int(row["offset"]), int(row["size"]))), 0, b""
        kind = "<u2" if self.width == 2 else "<u4"
        for _ in range(int(row["entries"])):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            n, at = read_varint(data, at + rest)
            yield None if self.null else from_key(key), np.frombuffer(data, kind, n, at)
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier."""
        if self.null or doc_id is None:
            return [ids for _, ids in self] if self.null and doc_id is None else []
        key = int.from_bytes(to_key(doc_id), "big")
        at = bloom_places(np.array([key], np.uint64), self.bits)
        if not (self.bloom[(at >> np.uint64(3)).astype(np.int64)] & (np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))).all():
            return []
        k, out = bisect_right(self.firsts, key) - 1, []
        while k >= 0:
            out = [ids for found, ids in self.block(k) if found == doc_id] + out
            if self.firsts[k] < key:
                break
            k -= 1
        return out


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_input(path: str):
    system, at = file_system(path)
    return system.open_input_file(at)


def save_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """Writes a file of its own for the task's attempt and moves it into place, so readers never see half of it."""
    from pyspark import TaskContext

    system, at = file_system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with system.open_output_stream(own) as out:
        out.write(np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    if system.get_file_info(at).is_file:  # left by an earlier attempt
        system.delete_file(at)
    system.move(own, at)


def load_arrays(path: str, kinds: str) -> list[np.ndarray]:
    """What save_arrays wrote; kinds: a letter an array, q, Q or d of 8 bytes each and I of 4."""
    with open_input(path) as file:
        data = file.read()
    out, at = [], 8 * (len(kinds) + 1)
    for kind, n in zip(kinds, np.frombuffer(data, "<i8", len(kinds), 8).tolist(), strict=True):
        out.append(np.frombuffer(data, np.dtype(kind).newbyteorder("<"), n, at))
        at += n * out[-1].itemsize
    return out


def write_shards(docs: DataFrame, folder: str, *, path: str | None = None, shards: int | None = None, end_id: int = END_ID) -> list[dict]:
    """Encodes, deals out by ranges of identifiers and writes one shard a range.

    Returns a row for each shard, in order: path, documents, ids. There is one for `SHARD_BYTES` of text, or as many as the
    session's shuffle partitions if that is more. Bounds of the ranges come from quantiles of the identifier column alone, so texts are encoded once, and what is shuffled are ids. A retried task writes the same
    file again under a name of its own and moves it into place, so readers never see half a shard.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or tokenizer_path(VOCABULARY)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, known, size = docs.agg(F.count("*"), F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    shards = shards or width_for(spark, size or 0, SHARD_BYTES)
    found = docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], max(10_000, 20 * shards))).first()[0]
    without = -(-shards * (rows - known) // rows) if rows else 0  # shards of null identifiers
    bounds = np.array(sorted(set(found or [])), np.int64)
    width = 2 if load(path).get_vocab_size() <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = segment_encoder(path), 0
        kind = f"<u{width}"
        end = np.array([end_id], kind).tobytes()

        def encoded(b: pa.RecordBatch) -> pa.RecordBatch:
            at = np.searchsorted(bounds, b.column(0).fill_null(0).to_numpy(), side="right").astype(np.int32)
            ids = [x.astype(kind).tobytes() + end for x in encoder.encode_array(b.column(1))]
            for k in np.flatnonzero(b.column(0).is_null().to_numpy(zero_copy_only=False)):
                at[k] = len(bounds) + 1 + zlib.crc32(ids[k]) % without
            return pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

        for b in sized(batches, 1, size=ENCODED_BYTES):
            yield encoded(b)
            held += b.nbytes
            if held >= 2 * ENCODED_BYTES:
                give_back()
                held = 0
        give_back()

    coded = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1 + without, F.col("shard")).sortWithinPartitions("doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        writer = stream = None
        for b in batches:
            for shard, doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if writer is None:
                    own, name = f"{at}/_{shard:06d}-{TaskContext.get().taskAttemptId()}", f"{at}/{shard:06d}.sst"
                    stream = system.open_output_stream(own)
                    writer = Writer(stream, width, doc_id is None)
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            stream.close()
            if system.get_file_info(name).is_file:  # left by an earlier attempt
                system.delete_file(name)
            system.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{shard:06d}.sst"]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.ids], pa.int64())], ["shard", "path", "documents", "ids"])

    done = dealt.mapInArrow(write, "shard int, path string, documents long, ids long")
    return sorted((r.asDict() for r in done.collect()), key=lambda s: s["shard"])  # a row for each shard


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    starts = np.cumsum([0, *(s["ids"] for s in shards)]).tolist()
    rows = [(s["path"], start) for s, start in zip(shards, starts, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, at = Reader(path), start
                for k in range(len(reader.index)):
                    out: list[tuple] = []
                    for doc_id, ids in reader.block(k):
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "path string, start long").repartition(len(rows)).mapInArrow(read, schema)


def lookup(shards: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document, by its identifier."""
    return [ids for s in shards for ids in Reader(s["path"]).get(doc_id)]


def written_and_read(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, shared_dir(spark, "sst")))
