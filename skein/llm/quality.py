"""Operator 9, quality rules as a learned decision list, native.

Statistics of a text are DataFrame expressions. From labelled documents a list of rules is learned by sequential
covering: grow a conjunction of thresholds by FOIL gain on two thirds of the rows, prune it on the rest, keep it if it
is precise enough there, take out what it covers, and go on. The list becomes one ordered CASE expression, so applying
it is a projection without shuffle or Python. Fitting reads at most `LABELLED_ROWS` labels (those with the smallest hash of
the identifier) and, where rows share identifiers, at most twice as many documents; it holds their statistics, a dozen
numbers each, on the driver.

Three-word windows are compared by 64-bit hashes within one text; windows that recur are found by sorting the hashes,
in n log n for a text of n words.

Cases: a null or empty text has no words and fails the base rules; a very long text is one row's expression, in n log n;
labels that are null or lack a document do not count, and without labels the list is empty, so that the base rules alone
decide; of rules that gain alike the first feature and lowest cut win; repeated rows and rows sharing an identifier are
judged each by their own text; an empty table gives no rows; extra columns are carried whatever their names, except that
results of the operator (`BASE`, base_failed, kept) replace such names in `judged`; `accepted` gives back all columns.
"""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carrying, kept_where, let, table

LABELLED_ROWS = 20_000
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_CONDITIONS = 0.9, 0.005, 24, 4
SPACE = r"\x20\x09-\x0D"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate", "line_words", "long_word_rate"]
FEATURES = ["n_words", *RATES]

Rule = list[tuple[str, str, float]]


def repeat_words(words: Column) -> Column:
    """How many words stand in three-word windows that are found twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(starts, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def of_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return covered(F.array_sort(F.transform(again, lambda x: x["i"])))

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, of_hashes))


def with_statistics(docs: DataFrame, rates: bool = True) -> DataFrame:
    """`docs` (doc_id, text, none of the names used here) with the base statistics and, unless told otherwise, the rates that
    rules may test."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumns({
        "_words": F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
    })
    gone = lambda pattern: F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
    })
    if rates:
        part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
        words, chars = F.col("n_words"), F.col("word_chars")
        df = df.withColumns({
            "mean_word": part(chars, words),
            "symbol_rate": part(F.col("n_symbols"), chars),
            "dup_line_rate": part(F.col("n_dup_lines"), F.size("_lines")),
            "repeat_rate": part(F.col("n_repeat_words"), words),
            "upper_rate": part(gone(r"\p{Lu}+"), chars),
            "digit_rate": part(gone(r"[0-9]+"), chars),
            "mark_rate": part(gone(r"\p{P}+"), chars),
            "distinct_rate": part(F.size(F.array_distinct("_words")), words),
            "line_words": part(words, F.size("_lines")),
            "long_word_rate": part(F.size(F.filter("_words", lambda w: F.length(w) > 20)), words),
        })
    return df.drop("_text", "_words", "_lines")


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[tuple[list[float], bool]]:
    """(statistics, whether the quality label is 0) of at most `rows` labelled documents."""
    sample = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `rows` pairs of integers
    found = with_statistics(joined).select(*FEATURES, "quality", "doc_id").orderBy("doc_id", "quality").limit(2 * rows).collect()
    return [([float(r[f]) for f in FEATURES], r["quality"] == 0) for r in found]


def matches(rule: Rule, row: list[float]) -> bool:
    return all(row[FEATURES.index(f)] <= x if op == "<=" else row[FEATURES.index(f)] > x for f, op, x in rule)


def learn(rows: list[tuple[list[float], bool]], seed: int = 7) -> list[Rule]:
    """Ordered rules for rejection, by sequential covering."""
    import numpy as np

    if not rows or not any(bad for _, bad in rows) or all(bad for _, bad in rows):
        return []
    x, bad = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    shuffled = list(range(len(rows)))
    random.Random(seed).shuffle(shuffled)
    prune = np.zeros(len(rows), bool)
    prune[shuffled[: len(rows) // 3]] = True
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    left, rules = np.ones(len(rows), bool), []

    def holds(rule: Rule) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for f, op, cut in rule:
            c = x[:, FEATURES.index(f)]
            out &= c <= cut if op == "<=" else c > cut
        return out

    def grow() -> Rule:
        rule: Rule = []
        inside = left & ~prune
        while len(rule) < MAX_CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
            p, n = (inside & bad).sum(), inside.sum()
            best, test = 0.0, None
            for k, name in enumerate(FEATURES):
                for cut in cuts[k]:
                    low = inside & (x[:, k] <= cut)
                    for op, m in (("<=", low), (">", inside & ~low)):
                        if (q := int((m & bad).sum())) and (gain := q * (math.log2(q / m.sum()) - math.log2(p / n))) > best + 1e-12:
                            best, test = gain, ((name, op, float(cut)), m)
            if test is None:
                break
            rule.append(test[0])
            inside = test[1]
        return rule

    def worth(rule: Rule) -> tuple[float, float]:
        m = holds(rule) & left & prune
        q = (m & bad).sum()
        return (q + 1) / (m.sum() + 2), q

    while len(rules) < MAX_RULES:
        rule = grow()
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r)[0])
        precision, q = worth(rule)
        if precision < MIN_PRECISION or q < max(2, MIN_COVER * prune.sum()):
            break
        rules.append(rule)
        left &= ~holds(rule)
        if not (left & bad & ~prune).any():
            break
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The list as one ordered CASE expression: true where a rule fires."""
    out = F.lit(False)
    for rule in reversed(rules):
        fires = reduce(lambda a, b: a & b, [F.col(f) <= cut if op == "<=" else F.col(f) > cut for f, op, cut in rule])
        out = F.when(fires, F.lit(True)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """`docs` with base statistics, base_failed and kept."""
    rules = learn(labelled(docs, labels, rows))

    def work(own: DataFrame) -> DataFrame:
        out = with_statistics(own, rates=bool(rules))
        return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(rules)).drop(*RATES)

    return carrying(docs, work)


def accepted(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    return carrying(docs, lambda own: kept_where(judged(own, labels, rows), F.col("kept")).select(*own.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")
