"""Shared folders of a cluster: where tables and checkpoints that executors read again are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only on one machine, where it is not set, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="somaframe-")


def new(spark: SparkSession) -> str:
    """A path in a new shared folder, which is removed when the driver ends: results are lazy, so a table must last as long."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared(spark)}/tables-{uuid.uuid4().hex}")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return f"{folder.toString()}/table"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again: a checkpoint that is compressed, and of which a reader takes only its columns."""
    path = new(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
