"""Operator 4, personal data by patterns and information-theoretic sanitisation, native.

Base spans come from fixed patterns per kind. What each discloses is estimated from the corpus: a term that keeps
standing in texts with a protected entity and hardly anywhere else reveals it even where the entity itself is masked.
With document counts n(.) over N documents and distinct contexts c(.) of an entity e, a context being a whole text,

    IC(e) = log2(N / c(e))        PMI(e; t) = log2(c(e, t) N / (c(e) n(t)))

a term t is disclosive for e if PMI(e; t) >= `disclosure` * IC(e), in at least `min_contexts` distinct contexts, and if the
two are not met by chance: 2 c(e, t) ln 2 PMI(e; t) >= `significance` (chi-squared of one degree, 10.83 for one in a
thousand), which a few texts of a small corpus do not reach. Texts that hold e between the same `BESIDE_CHARS` characters
on either side, everywhere they hold it, are one context, so that copies of one passage count once; the characters tell
passages apart and bound nothing else. Words inside base spans are no terms. A disclosive term gives its entity away
wherever it stands: every occurrence outside base spans, in every document, becomes a span of kind `term`. Masking puts a
kind's name in place of base spans and generalises terms to [TERM].

Since c(e, t) is at most c(e) and n(t), only entities with `min_contexts` contexts and words with min_contexts <= n(t)
<= N ** (1 - disclosure) * c(e) ** disclosure can pass; no others are paired, which leaves out no term. Up to `AT_ONCE`
disclosive words are sent to every task as one table in buckets by hash, in which each text's words are looked up where the
text is read, so that no text is shuffled; more of them are joined with the texts' distinct words, and those with the texts.
Both ways find the same terms.

Positions come from splitting at the pattern and adding lengths, in blocks, so a text with many spans costs little more
than linear time. The patterns below are the stated ones with possessive repeats and a look behind at run starts, which
find the same matches without retrying inside a run or deep recursion.

Cases: a null text is empty and has no spans, and stays null when masked; a null identifier is treated like any other; rows
sharing an identifier are each searched in their own text, which two hashes tell apart (128 bits with the identifier's);
a word of any length is a term if its letters are three or more; of terms that tie all are hidden; a very long text costs
little more than linear time, and one task; an empty table gives no rows; extra columns are carried by `mask` whatever
their names and ignored by `find`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, carrying, kept_where, let, staged, table

# Kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
GATES = {"email": "@", "ip": ".", "card": "", "phone": "+"}
ACCEPT: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    "card": lambda m: let(F.regexp_replace(m, "[ -]", ""), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d)),
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15),
}
BESIDE_CHARS = 96
WORD = r"\p{L}[\p{L}\p{M}'-]{2,}+"
DISCLOSURE, MIN_CONTEXTS, SIGNIFICANCE = 0.8, 3, 10.83
BLOCK = 256
AT_ONCE, BUCKET = 1 << 18, 4  # words in one table, some 8 MB, and in one of its buckets on average


def before(sizes: Column) -> Column:
    """For each element, the sum of those before it; in blocks, since each step of a fold copies its list."""

    def fold(xs: Column, start: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("out"), start.cast("int").alias("sum"))
        return F.aggregate(xs, zero, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).cast("int").alias("sum")), lambda a: a["out"])

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: (a + x).cast("int")))
        return let(fold(sums, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b, k: fold(b, F.get(starts, k)))))

    cut = F.transform(F.sequence(F.lit(0), ((F.size(sizes) - 1) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, BLOCK))
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(cut, of_blocks))


def located(text: Column, pattern: str, build: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """build(match, start, piece before, piece after) for every match, left to right."""

    def of(found: Column, pieces: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
        return let(before(sizes), lambda starts: F.transform(found, lambda m, i: build(m, (F.get(starts, i) + F.length(F.get(pieces, i))).cast("int"), F.get(pieces, i), F.get(pieces, i + 1))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.when(F.size(found) > 0, F.split(text, pattern, -1)), lambda pieces: of(found, pieces)))


SPAN = "array<struct<kind:string,start:int,end:int,entity:string,left:string,right:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """The kind's accepted spans, each with the text beside it."""
    build = lambda m, start, left, right: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).cast("int").alias("end"), F.concat(F.lit(kind + ":"), F.lower(m)).alias("entity"), F.right(left, F.lit(BESIDE_CHARS)).alias("left"), F.left(right, F.lit(BESIDE_CHARS)).alias("right"), ACCEPT[kind](m).alias("ok"))
    kept = F.filter(located(text, PATTERNS[kind], build), lambda s: s["ok"])
    none = F.array().cast(SPAN)
    gate = text.contains(GATES[kind]) if GATES[kind] else text.rlike("[0-9]")
    return F.when(gate, F.transform(kept, lambda s: s.dropFields("ok"))).otherwise(none).cast(SPAN)


def with_base(docs: DataFrame, out: str = "_base") -> DataFrame:
    """`docs` and its base spans by kind as listed, then start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_t", text).withColumn(out, F.concat(*[spans_of(F.col("_t"), k) for k in KINDS])).drop("_t")


def words_of(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def occurrences(text: Column, words: Column, base: Column) -> Column:
    """Spans of kind `term`: where `words` stand in the text outside base spans. Null and no words are none."""
    build = lambda m, start, left, right: F.struct(F.lit("term").alias("kind"), start.alias("start"), (start + F.length(m)).cast("int").alias("end"), F.array_contains(words, F.lower(m)).alias("ok"))
    hit = F.transform(F.filter(located(text, WORD, build), lambda t: t["ok"]), lambda t: t.dropFields("ok"))
    free = F.filter(hit, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.when(F.size(words) > 0, F.coalesce(free, none)).otherwise(none)


def document_counts(docs: DataFrame) -> DataFrame:
    """word, n: in how many documents each lower-cased word stands; partial sums come before the shuffle."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def disclosive(held: DataFrame, outside: DataFrame, docs: DataFrame, scratch: Scratch, *, disclosure: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS, significance: float = SIGNIFICANCE) -> DataFrame:
    """(entity, word) pairs over the threshold. held: id, entity, context; outside: id, text without its base spans."""
    entity = held.groupBy("entity").agg(F.count_distinct("context").alias("c_e")).where(F.col("c_e") >= min_contexts)
    total = F.broadcast(docs.agg(F.count("*").alias("total")))  # one row
    asked = scratch(held.join(entity, "entity").crossJoin(total).where("c_e < total").withColumn("most", F.pow("total", F.lit(1 - disclosure)) * F.pow("c_e", F.lit(disclosure)) * 1.001), "asked")
    seldom = document_counts(docs).crossJoin(F.broadcast(asked.agg(F.max("most").alias("top")))).where((F.col("n") >= min_contexts) & (F.col("n") <= F.col("top"))).select("word", "n")  # one row
    words = outside.join(asked.select("id").distinct(), "id", "left_semi").select("id", F.explode(words_of(F.col("text"))).alias("word")).join(seldom, "word")
    met = asked.join(words, "id").where("n <= most").select("entity", "context", "word", "n", "c_e", "total").distinct()
    pair = met.groupBy("entity", "word").agg(F.count("*").alias("c_et"), F.first("n").alias("n"), F.first("c_e").alias("c_e"), F.first("total").alias("total")).where(F.col("c_et") >= min_contexts)
    pmi = F.log2(F.col("c_et") * F.col("total") / (F.col("c_e") * F.greatest("n", "c_et")))
    return pair.where((pmi >= disclosure * F.log2(F.col("total") / F.col("c_e"))) & (2 * math.log(2) * F.col("c_et") * pmi >= significance)).select("entity", "word")


def keys() -> list[Column]:
    """What tells rows apart: two hashes of identifier and text; rows alike in both share their terms."""
    return [F.xxhash64("doc_id", "text").alias("_one"), F.xxhash64("text", "doc_id").alias("_two")]


def hidden(docs: DataFrame, **options) -> DataFrame:
    """word: the disclosive ones, staged. docs: doc_id, text (string)."""
    scratch = Scratch()
    plain = F.transform("_base", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    marks = F.transform("_base", lambda s: F.struct(s["entity"].alias("entity"), F.xxhash64(s["left"], s["right"]).alias("beside")))
    marked = scratch(kept_where(with_base(docs), F.size("_base") > 0).select(F.monotonically_increasing_id().alias("id"), masked(F.col("text"), plain, lambda kind: F.lit(" ")).alias("text"), marks.alias("marks")), "marked")
    held = scratch(marked.select("id", F.inline("marks")).groupBy("id", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("beside"))).alias("context")), "held")
    words = staged(disclosive(held, marked.select("id", "text"), docs, scratch, **options).select("word").distinct(), "words")  # what is returned reads it
    scratch.clear()
    return words


def searched(docs: DataFrame, words: DataFrame) -> DataFrame:
    """_one, _two (of `keys`), words: which of `words` each text holds, where it holds any. docs: doc_id, text (string)."""
    return docs.select(*keys(), F.explode(words_of(F.col("text"))).alias("word")).join(words, "word").groupBy("_one", "_two").agg(F.collect_set("word").alias("words"))


def looked_up(docs: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """`docs` and _said: which of the n `words` each text holds. Their buckets are one value that every task is sent once."""
    width = n // BUCKET + 1
    bucket = lambda word: F.pmod(F.xxhash64(word), F.lit(width)).cast("int")
    every = words.sparkSession.range(0, width, 1, 1).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("string").alias("word"))  # so that none is left out
    full = words.select(bucket(F.col("word")).alias("bucket"), "word").unionByName(every).groupBy("bucket").agg(F.collect_list("word").alias("words"))
    buckets = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "words")))["words"].alias("buckets")).scalar()
    held = let(F.col("_buckets"), lambda b: F.filter(words_of(F.col("text")), lambda w: F.array_contains(F.get(b, bucket(w)), w)))
    return docs.withColumn("_buckets", buckets).withColumn("_said", held).drop("_buckets")


def with_spans(docs: DataFrame, *, at_once: int = AT_ONCE, **options) -> DataFrame:
    """`docs` (doc_id, text, any others) with _base and _terms, arrays of kind, start, end."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    own = docs.select("doc_id", "text")
    words = hidden(own, **options)
    n = words.count()
    if n <= at_once:
        found = looked_up(docs, words, n)
    else:
        terms = staged(searched(own, words), "terms")  # so that its size is known to the join
        found = docs.select("*", *keys()).join(terms, ["_one", "_two"], "left").drop("_one", "_two").withColumnRenamed("words", "_said")
    plain = F.transform("_base", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    found = with_base(found).withColumn("_base", plain)
    return found.withColumn("_terms", let(F.col("_said"), lambda w: occurrences(F.col("text"), w, F.col("_base")))).drop("_said")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and terms (arrays of kind, start, end) of every row. Options: those of `disclosive`, and `at_once`."""
    return with_spans(docs.select("doc_id", "text"), **options).select("doc_id", F.col("_base").alias("base"), F.col("_terms").alias("terms"))


def masked(text: Column, spans: Column, name: Callable[[Column], Column] = lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))) -> Column:
    """`text` with each span replaced by its kind's name in brackets; overlapping spans become one, named after the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])))
    kind = "struct<out:array<struct<kind:string,start:int,end:int,prev:int>>,reach:int>"

    def add(a: Column, s: Column) -> Column:
        end = -s["back"]
        return F.when(s["start"] >= a["reach"], F.struct(F.concat(a["out"], F.array(F.struct(s["kind"], s["start"], end.alias("end"), a["reach"].alias("prev")))).alias("out"), end.alias("reach"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["reach"], end).alias("reach"))).cast(kind)

    def render(m: Column) -> Column:
        # the gap before a span starts where the merged one before it ends
        parts = F.transform(m["out"], lambda s: F.concat(F.substring(text, s["prev"] + 1, s["start"] - s["prev"]), name(s["kind"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, m["reach"] + 1, F.length(text)))

    zero = F.struct(F.array().cast("array<struct<kind:string,start:int,end:int,prev:int>>").alias("out"), F.lit(0).alias("reach")).cast(kind)
    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(ordered, zero, add), render))


def mask(docs: DataFrame, **options) -> DataFrame:
    """`docs` with personal data in `text` masked. Options: those of `disclosive`, and `at_once`."""

    def work(own: DataFrame) -> DataFrame:
        return with_spans(own, **options).withColumn("text", masked(F.col("text"), F.concat("_base", "_terms"))).drop("_base", "_terms")

    return carrying(docs, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "terms")).alias("spans"), F.size(F.concat("base", "terms")).cast("long").alias("n_spans"))
