"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def snapshot(df: DataFrame) -> DataFrame:
    """The rows as they are now; plans over it stay short. Only a local session gets a folder of its own where none is named; a cluster's must name it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="atlasfold-"))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session gets one of its own where none is named; a cluster's must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='atlasfold-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Written to the shared folder and read back: for loops, whose every round is computed once. ``remove`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def remove(*cuts: DataFrame) -> None:
    """Deletes cuts that nothing reads any more."""
    for df in cuts:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
