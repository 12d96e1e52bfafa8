import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.functions.chunking import chunked, chunks
from skein.functions.jsonpath import check_rule, parse, passes, resolve


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_clean(spark):
    assert one(spark, tx.clean, "﻿标题\r\n\r\n\r\n  第一行\t\t内容  \r\n\0") == "标题\n\n第一行 内容"
    assert one(spark, tx.clean, "é") == "é"
    assert one(spark, tx.clean, None) == ""


def test_tokens(spark):
    assert one(spark, tx.tokens, "SQLite 索引 foo_bar __ SQLite") == ["SQLite", "索", "引", "foo_bar"]
    assert one(spark, tx.terms, "Café foo_bar Straße") == ["cafe", "foo", "bar", "straße"]


def test_highlight(spark):
    assert one(spark, lambda c: tx.highlight(c, "SQL sqlite"), "SQLite and sql") == "<mark>SQLite</mark> and <mark>sql</mark>"
    assert one(spark, lambda c: tx.highlight(c, "C++ $1"), "c++ $1") == "<mark>c++</mark> <mark>$1</mark>"
    assert one(spark, lambda c: tx.highlight(c, " "), "same") == "same"


def test_like(spark):
    rows = spark.createDataFrame([("100% sure",), ("a_b",), ("aXb",)], "x string")
    assert [r[0] for r in rows.where(tx.like_all(F.col("x"), "A_B")).collect()] == ["a_b", "aXb"]


def test_query_terms_and_questions():
    assert tx.query_terms('"foo bar" baz baz "" +') == ["foo bar", "baz", "+"]
    assert tx.question_tokens("What is SQLite and sqlite 3 x?") == ["SQLite", "and", "3"]


@pytest.mark.parametrize("text, size", [("1.5KB", 1536), ("2MiB", 2 << 20), (7, 7), ("0", 0)])
def test_size(text, size):
    assert tx.parse_size(text) == size


@pytest.mark.parametrize("text", ["-1", "1XB", True, "0.3"])
def test_size_errors(text):
    with pytest.raises(ValueError):
        tx.parse_size(text)


def test_chunks():
    assert chunks("") == [] and chunks("  \n ") == []
    cut = chunks("abcdefghij" * 10, 30, 5)
    assert all(a[-5:] == b[:5] for a, b in zip(cut, cut[1:], strict=False))
    assert chunks("a" * 8 + ". " + "b" * 20, 12, 0)[0] == "a" * 8 + "."
    assert len(chunks("x" * 20, 10, 9)) == 11
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunks("x", size, overlap)


def test_json_paths():
    assert resolve({"a": [{"b": 1}, {"b": None}, {}]}, parse("$.a[*].b")) == [1, None]
    assert resolve({"a": {"x": 1, "y": 2}}, parse("a[*]")) == [1, 2]
    for bad in ("$.a.", "$..a", "$.a[-1]"):
        with pytest.raises(ValueError):
            parse(bad)
    rule = lambda **k: [check_rule({"path": "a"} | k)]
    assert passes({"a": 1}, rule(equals=1.0)) and passes({"a": None}, rule(exists=True)) and not passes({}, rule(not_equals=1))
    with pytest.raises(ValueError):
        check_rule({"path": "a", "in": []})


def test_citations(spark):
    from skein.operators import answers

    rows = spark.createDataFrame([("x [1]", [1]), ("x [2]", [1]), ("x", [1]), (answers.REFUSAL, []), (answers.REFUSAL + "[9]", []), (None, [1])], "answer string, available array<int>")
    assert [r["error"] for r in answers.validated(rows).collect()] == [None, "invalid:2", "missing", None, "invalid:9", "missing"]


@pytest.mark.parametrize("size, overlap", [(800, 100), (40, 7), (40, 0), (3, 0), (1, 0), (40, 11), (40, 12), (40, 39)])
def test_chunks_in_the_jvm(spark, size, overlap):
    """As plain Python cuts them, and no Python worker takes part where a pattern can say it."""
    draw = random.Random(size * 100 + overlap)
    texts = [None, "", " ", "x" * size, "x" * (size + 1), ("😀" * 9 + "。é ") * 200] + ["".join(draw.choice(signs) for _ in range(draw.randrange(4 * size + 300))) for signs in ("ab .", "abcdefgh", "a\u3000\x1c\n b", "é。，😀 x", " ") for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = chunked(docs, size=size, overlap=overlap)
    assert sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in found.collect()) == [(k, i, c) for k, t in enumerate(texts) for i, c in enumerate(chunks(t, size, overlap))]
    assert ("MapInArrow" in found._jdf.queryExecution().toString()) == (size == 1 or 2 * overlap > int(size * 0.55))


def test_folding_in_the_jvm(spark):
    """Every character as plain Python folds it, without a Python worker; what composition may skip it would not change."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b" for c in every[k : k + 500]) for k in range(0, len(every), 500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.lower("t").alias("low"), tx.folded(F.col("t")).alias("f"), F.regexp_count("t", F.lit(f"[{tx.COMPOSED}]")).alias("n"))
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    true = {r[0]: r[1] for r in spark.createDataFrame([(k, bare(t)) for k, t in enumerate(texts)], "k int, t string").select("k", F.lower("t")).collect()}
    assert {r["k"]: r["f"] for r in rows.collect()} == true and "Python" not in rows._jdf.queryExecution().toString()
    moved = {c for c in every if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c} | {x for c in every for x in unicodedata.normalize("NFD", c)[1:]} - {*map(chr, range(0x250))}
    assert not re.search("[%s]" % re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", tx.COMPOSED), "".join(moved))
    assert rows.agg(F.sum("n")).first()[0] > 20_000


def test_cleaning_clean_texts(spark):
    """Texts with nothing to tidy are let pass; the rules on all of them give the same."""
    draw = random.Random(5)
    every = [chr(c) for c in range(0x3100) if not 0x300 <= c < 0x370]
    texts = [f"a{c}b \n{c}{c} c{c}\n{c}\nd{c}" for c in every] + [f"a{c}b" for c in every] + ["".join(draw.choice(signs) for _ in range(12)) for signs in ("a \n", "ab\n", "a \t\r\n", "a\u2028\x85 \n", "\ufeff\0a ") for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}\x1c-\x1f\x85]+", ""), r"[\s\p{Z}\x1c-\x1f\x85]+$", "")
    for found, tidy in rows.select(tx.clean(F.col("t"), False), bare(tx._tidied(F.col("t")))).collect():
        assert found == tidy
