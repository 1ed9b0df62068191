"""Writers for manifests and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .array_files import file_system


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one chat row per line."""
    df.write.mode(mode).json(path)


def read_done(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The finished rows of all runs, with their run. With a schema, a path that is not there yet has no rows."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
    try:
        return reader.parquet(path).withColumn("run", F.col("run").cast("string"))
    except AnalysisException as missing:
        if schema is None or "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run", T.StringType())]))


def append_done(df: DataFrame, path: str, run: str, id_col: str = "video_id") -> None:
    """Add finished rows; a later run reads them back and skips their ids.

    A run owns the folder ``run=<run>`` below ``path``. Spark publishes it when its job has ended, so a run that was killed has
    no rows, and one that is repeated replaces its own; ids that another run has finished are not added again."""
    others = read_done(df.sparkSession, path, df.schema).filter(F.col("run") != run).select(id_col).distinct()
    df.join(others, id_col, "left_anti").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def write_report(
    df: DataFrame, path: str, run_tag: str, summary: Sequence[Column], fmt: str = "json", mode: str = "errorifexists"
) -> DataFrame:
    """One row per recording below ``run_tag=<tag>``, and a one-row summary next to it, which is returned.

    Only this run's folder is touched, so runs can be written side by side.
    """
    rows = f"{path.rstrip('/')}/per_video/run_tag={run_tag}"
    df.write.mode(mode).format(fmt).save(rows)
    back = df.sparkSession.read.schema(df.schema).format(fmt).load(rows)
    total = back.agg(F.count("*").alias("n_videos"), *summary).withColumn("run_tag", F.lit(run_tag))
    target = f"{path.rstrip('/')}/summary/run_tag={run_tag}"
    total.drop("run_tag").write.mode(mode).format(fmt).save(target)
    return total


def write_texts(df: DataFrame, path: str, name: str = "name", content: str = "content") -> int:
    """One file per row, named by the row, written by the tasks. A rerun writes the same files. Returns their number."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        files = 0
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/{file}") as out:
                    out.write((text or "").encode())
                files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]}, schema=pa.schema({"files": pa.int64()}))

    put_out = df.select(F.col(name).cast("string"), F.col(content).cast("string")).mapInArrow(put, "files long")
    return put_out.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first().n
