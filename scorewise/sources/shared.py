"""Tables written once to a folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, the warehouse, if it can be seen by all: on a file system
    of its own, or because everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.conf.get("spark.sql.warehouse.dir")
    scheme, found, _ = folder.partition(":")
    if (not found or scheme == "file") and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


@contextmanager
def _shuffles_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that writes a table are of no use once the table is there."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` under a fresh name in the shared folder and read it back: later plans start from files that
    outlive any executor. Large rows need row groups of few bytes, as readers hold up to a row group at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/scorewise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_the_job(spark):
        writer = df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write
        writer.parquet(path, compression="zstd")  # its buffers are small and reused, however many tables a query writes
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discarded(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` wrote and that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
