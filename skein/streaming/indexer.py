"""Indexing new files as they come. The file source sees new files only; `Store.index` and `Store.prune` remain the way to
take in edits and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store
from ..sources import files as fs


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Every batch of new text and Markdown files becomes one version of the store."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(folder)

    def add(batch: DataFrame, number: int) -> None:
        kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
        raw = batch.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), kind.alias("file_type"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.lit("").alias("parser_fingerprint"), fs.read_text("content", kind)["text"].alias("text"))
        if not raw.isEmpty():
            store.replace(raw)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
