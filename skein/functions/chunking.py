"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, strip

# Characters after which a chunk may end, and the share of a chunk before which it may not.
ENDS = "。！？.!?；;，,\n"
LEAST_SHARE = 0.55
SIZE, OVERLAP = 800, 100


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the chunk size")


def cut_place(text: str, at: int, size: int) -> int:
    """Where the chunk from `at` ends: after its last end mark, else before its last space, else at full size."""
    low, high = at + max(1, int(size * LEAST_SHARE)), at + size
    mark = max(text.rfind(c, low, high) for c in ENDS)
    if mark >= 0:
        return mark + 1
    space = text.rfind(" ", low, high)
    return space if space >= 0 else high


def chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The text's chunks, stripped, empty ones left out; neighbours share about `overlap` characters."""
    check(size, overlap)
    out, at, text = [], 0, text or ""
    while len(text) - at > size:
        end = cut_place(text, at, size)
        out.append(text[at:end].strip())
        at += max(end - at - overlap, 1)
    out.append(text[at:].strip())
    return [c for c in out if c]


def pattern(size: int, overlap: int) -> str | None:
    """`chunks` as a pattern: each match is what a chunk adds to the one before, which it begins with the last `overlap`
    characters of. None where a chunk may add less than that, or nothing is left to choose."""
    low = max(1, int(size * LEAST_SHARE))
    if not 2 * overlap <= low < size:
        return None

    def added(low: int, size: int) -> str:
        """To after the last mark, else before the last space, else to the full size; all if that is no more."""
        return f"(?:(?=.{{{size + 1}}})(?:.{{{low + 1},{size}}}(?<=[{ENDS}])|.{{{low},{size - 1}}}(?= )|.{{{size}}})|.{{1,{size}}}\\z)"

    return rf"(?s)\A{added(low, size)}|(?!\A){added(low - overlap, size - overlap)}"


def chunked(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, content, start_offset (always 0), chunk_id (from key and index): one row a chunk. With `part`, a
    document's texts of different parts are chunked each on its own, and its chunks numbered on in the parts' order; its
    parts meet in one task for that, which a bound on file sizes bounds. Texts stay in the JVM but for sizes that
    `pattern` can't express."""
    check(size, overlap)
    number = F.lit(0).cast("long") if part is None else F.col(part).cast("long")
    own = docs.select(key, F.col(text).alias("_text"), number.alias("_part"))
    if (found := pattern(size, overlap)) is None:
        out = _in_python(own, key, size, overlap)
    else:
        whole = lambda added: F.transform(added, lambda x, i: strip(F.concat(F.when(i > 0, F.right(F.get(added, i - 1), F.lit(overlap))).otherwise(""), x)))
        pieces = let(F.regexp_extract_all("_text", F.lit(found), F.lit(0)), whole)
        out = own.select(key, "_part", F.posexplode(F.filter(pieces, lambda c: c != "")).alias("chunk_index", "content")).withColumn("start_offset", F.lit(0).cast("long"))
    if part is not None:
        out = out.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("_part", "chunk_index")) - 1)
    return out.drop("_part").withColumn("chunk_id", F.xxhash64(key, "chunk_index"))


def _in_python(docs: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("_part", T.LongType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("start_offset", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 512):
                some = b.slice(low, 512)
                cut = [chunks(t, size, overlap) for t in some.column(1).to_pylist()]
                own = pa.array([k for k, c in enumerate(cut) for _ in c], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0).take(own), some.column(2).take(own), pa.array([i for c in cut for i in range(len(c))], pa.int32()), pa.array([x for c in cut for x in c], pa.string()), pa.array([0] * len(own), pa.int64())], schema.names)

    return docs.mapInArrow(work, schema)


def register(spark: SparkSession) -> None:
    """`chunk_text(text, size, overlap)` as a table function for SQL, to be used with LATERAL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index: int, content: string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(chunks(text, size, overlap))

    spark.udtf.register("chunk_text", ChunkText)
