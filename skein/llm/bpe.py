"""Operator 8, BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so a word may be cut there and its
fragments encoded each on its own; the ids, concatenated, are those of the whole word. Words come from the tokenizer's
own pre-tokenisation. Cuts are made between characters only, so that each fragment is text.

Cases: a null or empty text has no ids and decodes to the empty string; repeated rows and rows sharing an identifier are
each encoded; ties between merges go to the leftmost, as in the library; a special token's string in a text is that token,
as in the library; a very long text is one task's, cut into fragments as it is read; an empty table gives no rows; columns
other than the two named are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized, small
from .tokens import SegmentEncoder, load, packed, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the public pre-tokenisation pattern of byte-level vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether a byte pair occurs inside a token."""
    seen = np.zeros((256, 256), bool)
    for token in tokens:
        seen[list(token[:-1]), list(token[1:])] = True
    return seen


class ForcedEncoder(SegmentEncoder):
    """A SegmentEncoder whose parts are encoded from fragments between certain cuts."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = inner_pairs(self.token_bytes)
        self.plain_bpe = Tokenizer.from_str(load(path).to_str())
        self.plain_bpe.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain_bpe.encode_special_tokens = True  # fragments of ordinary text only

    def fragments(self, word: str) -> list[str]:
        data = np.frombuffer(word.encode(), np.uint8)
        if len(data) < 2:
            return [word]
        cut = ~self.inner[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        if not cut.any():
            return [word]
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(data)]
        raw = data.tobytes()
        return [raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)]

    def bulk(self, parts: list[str]) -> list[bytes]:
        cut = [[] if p in self.special else [f for w in WORDS.findall(p) for f in self.fragments(w)] for p in parts]
        flat = list(dict.fromkeys(f for row in cut for f in row))
        ids = dict(zip(flat, (packed(e.ids) for e in self.plain_bpe.encode_batch_fast(flat, add_special_tokens=False)), strict=True))
        return [self.special[p] if p in self.special else b"".join([ids[f] for f in row]) for p, row in zip(parts, cut, strict=True)]


@lru_cache(maxsize=2)
def forced_encoder(path: str) -> ForcedEncoder:
    return ForcedEncoder(path)


def decode(ids: np.ndarray, tokens: list[bytes]) -> str:
    """The text of ids: the tokens' bytes, joined; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    return forced_encoder(path).encode_array(texts)


def with_ids(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """`docs` and a column of the text's ids."""
    path = path or tokenizer_path(VOCABULARY)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids = pa.array([x.astype(np.int32) for x in encode_texts(b.column(text), path)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), ids], [f.name for f in schema.fields])

    return docs.mapInArrow(work, schema)


def with_text(coded: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """`coded` and a column of the text that the ids stand for; null ids give null."""
    path = path or tokenizer_path(VOCABULARY)
    schema = T.StructType([*(f for f in coded.schema.fields if f.name != out), T.StructField(out, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = forced_encoder(path).token_bytes
        for b in small(batches):
            texts = pa.array([None if x is None else decode(np.asarray(x, np.int64), tokens) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), texts], [f.name for f in schema.fields])

    return coded.mapInArrow(work, schema)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, in one pass that keeps no ids."""
    path = path or tokenizer_path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = forced_encoder(path)
        decimal = [b"%d," % i for i in range(len(encoder.token_bytes))]
        for b in sized(batches, 1):
            rows = encode_texts(b.column(1), path)
            written = [hashlib.sha256(b"".join(map(decimal.__getitem__, x.tolist()))[:-1]).hexdigest() for x in rows]
            decoded = [hashlib.sha256(decode(x, encoder.token_bytes).encode()).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(written), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
