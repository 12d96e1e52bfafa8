"""The folder that the cluster's machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI) in the one that spark.checkpoint.dir names. Unset on one machine, as in tests, a temporary
    folder stands in; on a cluster that is an error, since executors would write to disks of their own."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that what follows reads them and does not compute them again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
