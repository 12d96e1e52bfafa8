"""Exact, cached use of the public tokenizers inside executors.

Texts are cut where the tokenizer's own rules put a boundary whatever stands around it. The parts between such cuts
recur, so each worker encodes a part once and looks it up afterwards. Caches hold at most about `CACHE_ENTRIES`, and long
parts are never kept, so memory is bounded.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_ENTRIES = 900_000
CACHED_CHARS = 48
# The code points with the Unicode property White_Space, which the tokenizers' \s stands for.
WHITE_POINTS = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE = "".join(map(chr, WHITE_POINTS))
LETTERS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[.,!?;:|])"  # a letter and this punctuation never share a token
SEGMENT = re.compile(f"[{WHITE}]*{LETTERS}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
PLAIN_WORD = re.compile(LETTERS + r"|[^ \t\n\r\x0b\x0c]+")
ONE_WORD = re.compile(r"[a-z\xe0-\xf6\xf8-\xff]+")
SPACED_WORD = re.compile(r" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: White space other than single spaces and line ends between words: such a text is cut by SEGMENT instead.
ODD_WHITE = "".join(map(chr, sorted({*WHITE_POINTS} - {0xA, 0x20})))
JOINED = "\x01"
UNEVEN = f"[ \n] |[{ODD_WHITE}{JOINED}]"  # for RE2, as the next one
LETTER_MARK = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,!?;:|])"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def cut_at(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids up to each of `ends` (exclusive, ascending), as bytes."""
    whole, at = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


class Cache(dict):
    """key -> value, made by `make_many`. Once full it takes no more keys, since frequent ones come early; it starts
    anew after as many misses as it holds keys. Long keys, and those that come when it is full, stay for one call only."""

    def __init__(self, make_many):
        super().__init__()
        self.make_many, self.missed = make_many, 0

    def need(self, rows: list[list[str]]) -> list[str]:
        """Afterwards every key of the rows is there; those returned are to be given to `release` after use."""
        full = len(self) >= CACHE_ENTRIES
        if full and self.missed > CACHE_ENTRIES:
            self.clear()
            full, self.missed = False, 0
        new = list({k for row in rows for k in row if k not in self})
        if new:
            self.update(zip(new, self.make_many(new), strict=True))
            self.missed += full * len(new)
        return new if full else [k for k in new if len(k) > CACHED_CHARS]

    def release(self, keys: list[str]) -> None:
        for k in keys:
            del self[k]


class Encoder:
    """Values of texts (ids as little-endian unsigned 32-bit bytes, unless `bulk` is replaced), joined from the values of
    parts. Subclasses say how a text is cut into parts."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.parts = Cache(self.bulk)

    def library(self, parts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def values(self, parts: list[str]) -> list[bytes]:
        passing = self.parts.need([parts])
        out = list(map(self.parts.__getitem__, parts))
        self.parts.release(passing)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's value, for few texts."""
        rows = [self.cut_text(t) for t in texts]
        found = dict(zip(keys := list({w for row in rows for w in row}), self.values(keys), strict=True))
        return [b"".join(map(found.__getitem__, row)) for row in rows]

    def encode_array(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids. Parts are split and numbered by Arrow, so Python sees each distinct one once a batch."""
        flat, offsets, extra = self.numbered(texts)
        coded = flat.dictionary_encode()
        values = self.values(self.named(coded.dictionary.to_pylist()))
        number = coded.indices.to_numpy()
        if extra:  # each text's first part has a value of its own
            number = number.copy()
            number[offsets[:-1]] = len(values) + np.arange(len(extra))
            values += extra
        store = np.frombuffer(b"".join(values), "<u4")
        size = np.array([len(v) // 4 for v in values], np.int64)
        start = np.cumsum(size) - size
        sizes = size[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = store[np.repeat(start[number] - ends[:-1], sizes) + np.arange(ends[-1])]
        at = ends[offsets]
        return [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


class WordEncoder(Encoder):
    """A tokenizer that lower-cases and drops white space, and marks the end of each word in the token's name.

    Its special tokens hold no white space and no capitals, so runs between ASCII white space are encoded each on its
    own, A-Z lower-cased first, which leaves fewer words.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    def cut_text(self, text: str) -> list[str]:
        return PLAIN_WORD.findall(text)

    def named(self, parts: list[str]) -> list[str]:
        return parts

    def numbered(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes]]:
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        cut = pc.replace_substring_regex(low, LETTER_MARK, r"\1 \2")
        for content in self.special:  # neither cut nor made by lower-casing
            cut = pc.if_else(pc.match_substring(low, content), texts, cut)
        words = pc.ascii_split_whitespace(cut)
        return words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py(), []

    def bulk(self, parts: list[str]) -> list[bytes]:
        out = dict.fromkeys(parts)
        if simple := [p for p in parts if ONE_WORD.fullmatch(p)]:
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids)
            out.update(zip(simple, cut_at(ids, np.flatnonzero(self.ends[ids]) + 1), strict=True))
        if rest := [p for p, v in out.items() if v is None]:
            out.update(zip(rest, self.library(rest), strict=True))
        return [out[p] for p in parts]


class SegmentEncoder(Encoder):
    """A byte-level tokenizer: white space and the run after it form a part, since the tokenizer always cuts after a run
    that white space follows. A special token's string is matched first, and what lies between is cut anew."""

    def __init__(self, path: str):
        super().__init__(path)
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = {c: packed([i]) for c, i in special.items()}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.token_bytes = token_bytes(self.tok)
        self.sizes = np.array([len(b) for b in self.token_bytes])

    def cut_text(self, text: str) -> list[str]:
        if self.pattern and self.pattern.search(text):
            return [w for p in self.pattern.split(text) for w in ([p] if p in self.special else SEGMENT.findall(p))]
        return SEGMENT.findall(text)

    def named(self, parts: list[str]) -> list[str]:
        return [p[1:] if p[:1] == JOINED else " " + p for p in parts]

    def numbered(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes]]:
        """Even texts are split at spaces, where a part begins, and between letters and marks, where JOINED stands in for
        the space; other texts count as one part, encoded apart."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNEVEN)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        words = pc.split_pattern(pc.replace_substring_regex(pc.if_else(odd, "", texts), LETTER_MARK, rf"\1 {JOINED}\2"), " ")
        flat, offsets = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
        whole = texts.filter(odd).to_pylist()
        first = self.encode(flat.take(pa.array(offsets[:-1])).to_pylist())
        for k, value in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist(), self.encode(whole), strict=True):
            first[k] = value
        return flat, offsets, first

    def bulk(self, parts: list[str]) -> list[bytes]:
        """Parts that start with a space and end in a letter can stand in one text: each space after a letter is a cut."""
        out = dict.fromkeys(parts)
        if simple := [p for p in parts if SPACED_WORD.fullmatch(p)]:
            ids = np.asarray(self.tok.encode_batch_fast(["".join(simple)], add_special_tokens=False)[0].ids)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in simple])) + 1
            out.update(zip(simple, cut_at(ids, ends), strict=True))
        if rest := [p for p, v in out.items() if v is None]:
            out.update(zip(rest, self.library(rest), strict=True))
        return [out[p] for p in parts]


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, and the other bytes, in order, for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(tok) -> list[bytes]:
    """The bytes of each id; a special token's are those of its own string."""
    letters, special = byte_letters(), {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    out = [b""] * tok.get_vocab_size()
    for token, i in tok.get_vocab().items():
        out[i] = special[i].encode() if i in special else bytes([letters[c] for c in token])
    return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def segment_encoder(path: str) -> SegmentEncoder:
    return SegmentEncoder(path)


def forget() -> None:
    """Lets go of cached parts that an earlier step left in this worker."""
    word_encoder.cache_clear()
    segment_encoder.cache_clear()
    give_back()
