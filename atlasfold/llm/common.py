"""Shared plumbing: table reads, bounded Arrow slices, lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of text that a Python worker turns into words at a time.
SLICE_BYTES = 4 << 20
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class Numbers(dict):
    """Numbers for keys, given out from 0 as they come up; those that are new are listed."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n

    def take_fresh(self) -> list:
        """The keys that are new since last time."""
        out, self.fresh = self.fresh, []
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session gets one of its own where none is named; a cluster's must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='atlasfold-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut", by: str | None = None, per_file: int = 0) -> DataFrame:
    """Write to the shared folder and read back: a lineage cut that survives lost executors. ``remove_cuts`` deletes it.

    Rows of each of the few values of column ``by`` are files of their own. ``per_file``: rows of a file at most, for rows
    so large that a reader, which takes up to 4,096 rows of a file at a time, would hold too much.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.option("maxRecordsPerFile", per_file).parquet(path)
    else:
        # a file open for each value, so that rows needn't be sorted by it
        before = spark.conf.get(WRITERS)
        spark.conf.set(WRITERS, "8")
        df.write.partitionBy(by).parquet(path)
        spark.conf.set(WRITERS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def remove_cuts(*cuts: DataFrame) -> None:
    """Delete the files of cuts: only of those whose every reader has been written itself."""
    for df in cuts:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of about ``limit`` bytes of ``column`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
