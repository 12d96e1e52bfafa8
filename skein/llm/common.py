"""Shared folder, staged tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI) in the shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent on one machine, as in tests, a temporary folder stands in for it; on a cluster, whose
    executors do not share such a folder, that is an error.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder as Parquet and reads them back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the files of a table made by `staged` once no later job reads them."""
    path = getattr(df, "staged_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Staged tables of one operator; those that no later job reads are deleted together."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.folders: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(staged(df, name))
        return self.tables[-1]

    def folder(self, spark: SparkSession, name: str) -> str:
        """A folder for files that tasks write."""
        self.folders.append((spark, shared_dir(spark, name)))
        return self.folders[-1][1]

    def clear(self) -> None:
        for df in self.tables:
            unstage(df)
        for spark, path in self.folders:
            delete(spark, path)
        self.tables.clear()
        self.folders.clear()


def sound_key(df: DataFrame, key: str, check: str) -> Column:
    """The 64-bit hash `key` told apart by another one, `check`: rows alike in both get one value, all others different ones.

    Of n values, about n ** 2 / 2 ** 65 share a key without being alike (70 of 5e10). Those, and only those, come to the
    driver, and get a key made from both hashes.
    """
    shared = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(check).alias("low"), F.max(check).alias("high")).where("low <> high").select(key)
    shared = [r[0] for r in shared.collect()]
    return F.when(F.col(key).isin(shared), F.xxhash64(F.lit(1), key, check)).otherwise(F.col(key)) if shared else F.col(key)


def carrying(docs: DataFrame, work: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """work(docs) with all columns but `key` and `text` packed into one, `_carried`, while it runs, so that no name of theirs
    clashes with one of its own. Columns that `work` adds replace carried ones of the same name; others come back in place."""
    rest = [c for c in docs.columns if c not in (key, text)]
    own = [F.col(key), F.col(text)]
    out = work(docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_carried")) if rest else docs)
    new = [c for c in out.columns if c not in (key, text, "_carried")]
    taken = {c.lower() for c in new}
    back = [F.col(c) if c in (key, text) else F.col("_carried").getField(c).alias(c) for c in docs.columns if c.lower() not in taken]
    return out.select(*back, *[F.col(f"`{c}`") for c in new])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width_for(spark: SparkSession, size: int, most: int) -> int:
    """Partitions for `size` bytes at `most` each, the session's number at least."""
    return max(shuffle_width(spark), -(-size // most))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds an expression to a lambda variable, so that it is computed once a row however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def kept_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filters by computed columns where they have been computed. A plain filter moves below the projections, which
    copies their expressions into it, even into the lambdas of one another; it stays above one that numbers rows."""
    return df.withColumn("_at", F.monotonically_increasing_id()).where(condition & (F.col("_at") >= 0)).drop("_at")


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows, which bounds what Python objects a worker holds at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sized(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096, size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows and about `size` bytes of a text column (one longer text stays whole)."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if k > at and (held + n > size or k - at >= rows):
                yield b.slice(at, k - at)
                at, held = k, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of Arrow batches where it is above `BATCH_BYTES`: long texts would make
    batches of ten thousand rows large both in the JVM and in workers."""
    now = spark.conf.get(BATCH_SETTING, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Hands a worker's free memory back to the system, since workers stay for a while after their last task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # of glibc only
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
