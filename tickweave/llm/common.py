"""What the operators of this subpackage share: table access, scratch tables, block keys."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else is part of one.
WORD_BYTES = rb"[^\x20\x09-\x0D]+"

_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where that is unset, a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append("file://" + tempfile.mkdtemp(prefix="tickweave-"))
    return _local_scratch[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Jobs that run within have Arrow batches of so many rows: texts reach Python workers a few MB at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    A table of hashes is stored as it is: compression would only take time and buffers outside the heap.
    """
    path = scratch_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", "none" if hashes else "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing will read again."""
    files = df.inputFiles()
    if files:
        drop_folder(df.sparkSession, files[0].rpartition("/")[0])


def with_defaults(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types; other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def slices(batches, rows: int = 1000):
    """The rows of Arrow batches, so many at a time: what a task builds for its output stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
