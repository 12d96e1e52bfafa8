"""Text functions as column expressions. Only Unicode composition leaves the JVM, and only for rows that may need it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a strip removes, sentence marks, and the ranges that tokens are made of.
EDGE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"(?<!_)(?=_*+[A-Za-z0-9])[A-Za-z0-9_]++|[\x{4e00}-\x{9fff}]"  # a run of underscores alone is none
TERM = r"[\p{L}\p{N}\p{Co}]++"
CJK = "[一-鿿]"
# Characters that composition leaves as they are whatever stands beside them; any other may need it.
COMPOSED = r"\x{0}-\x{2ff}\x{38e}-\x{482}\x{48a}-\x{52f}\x{1e00}-\x{1eff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20c0}\x{2190}-\x{22ff}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30a1}-\x{30fe}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{ff01}-\x{ffe6}"
HANGUL = 0xAC00, 0xD7A3
# Characters that cleaning leaves where they are: all but what `EDGE` has (line feed and space aside), byte-order marks and NULs.
KEPT = r"\n\x20-\x84\x86-\x9f\xa1-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{fefe}\x{ff00}-\x{10ffff}\x{1}-\x{8}\x{e}-\x{1b}"
MARK_OPEN, MARK_CLOSE = "<mark>", "</mark>"
# Words of a question that are no search terms.
STOP_WORDS = """a an are can could does explain how is please the what why 介绍 报道 什么 作用 使用 可以 吗 呢 和 哪些 如何 怎么 怎样 是否 是 有 有什么 的
能否 请 请问 解释 为什么 与 区别 各 各赢 多少 多久 哪个 分别 情况 统计 赛后 最终 比赛 赛季 总结 提前 结束 发生 时候 做 场 类 词 他 又""".split()
UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3, "t": 4, "tb": 4, "tib": 4}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds an expression to a lambda variable, so that it is computed once a row however often `body` names it. The body
    stays out of the code that Spark generates, which the JVM does not compile if it grows large."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@cache
def _unaccented() -> tuple[str, str, dict[str, str]]:
    """Characters without their accents, as from and to for `translate` (from what has no counterpart is removed), and those
    that become several characters, Hangul aside."""
    one, none, several = {}, [], {}
    for c in map(chr, (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and not HANGUL[0] <= c <= HANGUL[1])):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if not bare:
            none.append(c)
        elif len(bare) > 1:
            several[c] = bare
        elif bare != c:
            one[c] = bare
    return "".join([*one, *none]), "".join(one.values()), several


def _spelled(text: Column) -> Column:
    """Hangul syllables as their letters, and the few others that become several characters."""
    several = _unaccented()[2]
    lead, vowel, tail = (F.array(*[F.lit(chr(x) if x else "") for x in r]) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), [0, *range(0x11A8, 0x11C3)]))
    named = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def one(c: Column) -> Column:
        n = F.ascii(c) - HANGUL[0]  # the code of the first character
        syllable = F.concat(F.get(lead, F.floor(n / 588).cast("int")), F.get(vowel, F.floor(n % 588 / 28).cast("int")), F.get(tail, n % 28))
        return F.when((n >= 0) & (n <= HANGUL[1] - HANGUL[0]), syllable).otherwise(F.coalesce(F.element_at(named, c), c))

    odd = text.rlike(r"[^\x{0}-\x{9ca}]") & text.rlike("[\\x{%x}-\\x{%x}%s]" % (*HANGUL, "".join(several)))
    return F.when(odd, F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")).otherwise(text)


def nfc(text: Column) -> Column:
    """Canonical composition. Text that is surely composed, such as any below U+0300, stays in the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2ff}]") & text.rlike(f"[^{COMPOSED}]"), text)), text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE))


def clean(text: Column, compose: bool = True) -> Column:
    """Composed, without byte-order marks and NULs, one kind of line end, single spaces, stripped lines, at most one
    blank line in a row, stripped ends. Null gives the empty string. Defined on whole texts, whatever their length."""
    x = F.coalesce(text, F.lit(""))
    return let(nfc(x) if compose else x, lambda t: strip(F.when(t.contains("  ") | t.contains(" \n") | t.contains("\n ") | t.contains("\n\n\n") | t.rlike(f"[^{KEPT}]"), _tidied(t)).otherwise(t)))


def _tidied(x: Column) -> Column:
    for found, instead in (("\ufeff", ""), ("\0", ""), ("\r\n", "\n"), ("\r", "\n")):
        x = F.replace(x, F.lit(found), F.lit(instead))
    x = F.regexp_replace(x, "[ \t]{2,}|\t", " ")
    inner = r"[\p{Z}\x09\x0b\x0c\x1c-\x1f\x85]"
    x = F.regexp_replace(F.regexp_replace(x, f"(?m){inner}+$", ""), f"(?m)^{inner}+", "")
    return F.regexp_replace(x, "\n{3,}", "\n\n")


def tokens(text: Column) -> Column:
    """ASCII word runs and single CJK characters, in order, each spelling once; runs of underscores alone go."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def token_terms(text: Column) -> Column:
    """Terms of the text's tokens, none of which has an accent."""
    return F.regexp_extract_all(F.lower(F.array_join(tokens(text), " ")), F.lit(TERM), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case without accents."""
    given, instead, _ = _unaccented()
    return F.lower(F.when(text.rlike(r"[^\x{0}-\x{7f}]"), F.translate(_spelled(text), given, instead)).otherwise(text))


def terms(text: Column) -> Column:
    """Letter and digit runs of the folded text, in order, repeats included."""
    return F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0))


def fold_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query_terms(query: str) -> list[str]:
    """A user's query: quoted phrases and bare words, in order, each once."""
    found = (a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', query.strip()))
    return list(dict.fromkeys(t for t in (x.strip().strip('"') for x in found) if t))


def plain_tokens(text: str) -> list[str]:
    found = re.findall("[A-Za-z0-9_]+|[一-鿿]", text)
    return list(dict.fromkeys(t for t in found if any(c.isalnum() for c in t)))


def plain_terms(text: str) -> list[str]:
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    return [t for t in re.split(r"_+", "".join(c if c.isalnum() or unicodedata.category(c) == "Co" else "_" for c in bare)) if t]


def question_tokens(question: str) -> list[str]:
    """A question's search tokens: no stop words, no single characters but digits, each once whatever its case."""
    out: dict[str, str] = {}
    for t in plain_tokens(question):
        low = t.casefold()
        if low not in STOP_WORDS and (len(low) > 1 or low.isdigit()):
            out.setdefault(low, t)
    return list(out.values())


def highlight(text: Column, query: str, before: str = MARK_OPEN, after: str = MARK_CLOSE) -> Column:
    """Hits of the query's terms wrapped, longest terms first, case aside; the text's own spelling stays."""
    found = sorted(query_terms(query), key=len, reverse=True)
    if not found:
        return text
    quoted = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, "(?iu)" + "|".join(re.escape(t) for t in found), f"{quoted(before)}$0{quoted(after)}")


def like_all(content: Column, query: str) -> Column:
    """Every term of the query is LIKE-contained, ASCII case aside; a user's % and _ act as wildcards."""
    out = F.lit(True)
    for t in query_terms(query):
        low = t.translate({c: c + 32 for c in range(65, 91)})
        out &= F.call_function("like", fold_ascii(content), F.lit("%" + low.replace("!", "!!") + "%"), F.lit("!"))
    return out


def citations(answer: Column) -> Column:
    """Numbers cited as [n], in order, with repeats; one beyond all longs is the largest long, which no source has."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("long"), F.lit(2**63 - 1)))


def citation_label(number: Column, filename: Column, chunks: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), filename, F.lit("，分段 "), F.array_join(F.transform(chunks, lambda x: x.cast("string")), "、"))


def redact(text: Column, key: str = "", url: str = "") -> Column:
    """A configured key and base address replaced by their names."""
    for secret, name in ((key, "[REDACTED]"), (url, "[REDACTED_URL]")):
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(name))
    return text


def answer_key(text: Column) -> Column:
    """For comparing answers: no backticks, stars, underscores or white space, lower case, any colon as one sign."""
    return F.translate(F.lower(F.regexp_replace(text, r"[`*_\s\p{Z}]", "")), "：∶:", "比比比")


def contains_any(text: Column, alternatives: Column) -> Column:
    """Whether any alternative stands in the text, both as answer keys."""
    key = answer_key(text)
    return F.exists(alternatives, lambda a: key.contains(answer_key(a)))


EXCERPT, EXCERPT_PLAIN, BEFORE, AFTER, GAP = 1200, 400, 70, 150, 20
SPANS = "array<struct<low:int,high:int>>"


def relevant_excerpt(evidence: Column, facts: Column) -> Column:
    """The evidence around the first alternative found of each fact (from `BEFORE` characters before it to `AFTER` from
    its start), spans at most `GAP` apart joined, `EXCERPT` characters at most; its beginning where nothing is found. facts:
    arrays of alternatives, which are looked for without their white space."""

    def place(alternatives: Column, low: Column) -> Column:
        bare = F.transform(alternatives, lambda a: F.lower(F.regexp_replace(a, r"[\s\p{Z}]+", "")))
        return F.get(F.filter(F.transform(bare, lambda a: F.position(a, low)), lambda p: p > 0), F.lit(0)) - 1

    def spans(flat: Column) -> Column:
        places = let(F.lower(flat), lambda low: F.filter(F.transform(F.coalesce(facts, F.array().cast("array<array<string>>")), lambda f: place(f, low)), lambda p: p.isNotNull()))
        return F.array_sort(F.transform(places, lambda p: F.struct(F.greatest(p - BEFORE, F.lit(0)).cast("int").alias("low"), F.least(p + AFTER, F.length(flat)).cast("int").alias("high")))).cast(SPANS)

    def joined(found: Column) -> Column:
        # a span opens a stretch if it starts more than GAP after all before it; a stretch ends where the last of its spans does
        reach = lambda k: F.array_max(F.transform(F.slice(found, 1, k), lambda s: s["high"]))
        opens = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda k: (k == 0) | (F.get(found, k)["low"] - reach(F.greatest(k, F.lit(1))) > GAP))
        return let(opens, lambda o: F.transform(o, lambda k, i: F.struct(F.get(found, k)["low"].alias("low"), reach(F.coalesce(F.get(o, i + 1), F.size(found))).alias("high"))))

    def shown(flat: Column) -> Column:
        cut = lambda found: F.left(F.array_join(F.transform(joined(found), lambda s: F.trim(F.substring(flat, s["low"] + 1, s["high"] - s["low"]))), " ... "), F.lit(EXCERPT))
        return let(spans(flat), lambda found: F.when(F.size(found) == 0, F.left(flat, F.lit(EXCERPT_PLAIN))).otherwise(cut(found)))

    return let(F.trim(F.regexp_replace(F.coalesce(evidence, F.lit("")), r"[\s\p{Z}]+", " ")), shown)


def parse_size(value: str | int | float) -> int:
    """Bytes of '1.5GiB', '512MB' (1,024-based either way) or a bare number."""
    from decimal import Decimal, InvalidOperation

    if isinstance(value, bool):
        raise ValueError("a size is a number of bytes, with a unit or without")
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*", str(value))
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"no size: {value!r}")
    try:
        size = Decimal(m[1]) * 1024 ** UNITS[m[2].lower()]
    except InvalidOperation:
        raise ValueError(f"no size: {value!r}") from None
    if size != int(size):
        raise ValueError(f"not a whole number of bytes: {value!r}")
    return int(size)
