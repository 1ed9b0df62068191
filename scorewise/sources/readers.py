"""Readers for score series, lists, annotations, metadata trees, manifests and rating sheets."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewise.functions import ids
from scorewise.functions.text import strip
from scorewise.operators.blocks import number_by_range

from . import array_files
from .json_arrays import read_json_array

ANNOTATION = "video_id STRING, explanation STRING, anomaly_start_frame INT, anomaly_end_frame INT"
METADATA = (
    "video_id STRING, gate_score DOUBLE, flagged BOOLEAN, n_segments INT, segment_scores ARRAY<DOUBLE>, "
    "anomalous_segments ARRAY<STRUCT<start_snippet: INT, end_snippet: INT, `start`: INT, `end`: INT, "
    "selected_snippets: ARRAY<STRUCT<snippet_idx: INT, score: DOUBLE>>>>, "
    "extracted_frames ARRAY<STRUCT<snippet_idx: INT, score: DOUBLE, frame_num: INT, file: STRING>>"
)
MANIFEST = (
    "id STRING, video_id STRING, video_type STRING, strategy STRING, system STRING, "
    "conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>, images ARRAY<STRING>, "
    "frame_indices ARRAY<INT>, scores ARRAY<DOUBLE>"
)
VARIANT_OUTPUT = (
    "video_id STRING, is_anomalous_gt INT, total_frames INT, frames_sampled INT, sampled_indices ARRAY<INT>, "
    "used_pipeline_segment BOOLEAN, anomaly_detected BOOLEAN, explanation STRING"
)
RATINGS = ("C", "S", "Co", "F")


# --- series ----------------------------------------------------------------------------------------------------

def read_series(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(series_id, idx, score)`` rows.

    ``parquet``: a long table as it is, or one row per series with a ``scores`` array. ``npy``: one array file per
    series, whose byte ranges are read by several tasks; where only Spark's readers reach the path, a file is one task.
    """
    if fmt == "npy":
        if array_files.reachable(path):
            spark.dataSource.register(array_files.ArrayFiles)
            values = spark.read.format("npy").load(path)
            return values.select(ids.feature_id(F.col("path")).alias("series_id"), "idx", F.col("value").alias("score"))

        def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, content in zip(batch["series_id"], batch["content"]):
                    values = np.load(io.BytesIO(content), allow_pickle=False).reshape(-1).astype("float64")
                    yield pd.DataFrame({"series_id": name, "idx": np.arange(len(values)), "score": values})

        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
        named = files.select(ids.feature_id(F.col("path")).alias("series_id"), "content")
        return named.mapInPandas(arrays, "series_id string, idx long, score double")
    df = spark.read.format(fmt).load(path)
    if "scores" in df.columns:
        df = df.select("series_id", F.posexplode("scores").alias("idx", "score"))
    return df.select("series_id", F.col("idx").cast("long"), F.col("score").cast("double"))


# --- lists -----------------------------------------------------------------------------------------------------

def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One path per line -> id; blank lines dropped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(ids.feature_id(F.col("value")).alias("video_id"), F.trim("value").alias("path"))


def parse_video_list(lines: DataFrame, layout: str = "test") -> DataFrame:
    """Whitespace fields -> id, frame count, label; blank lines are skipped.

    ``train`` lines carry an extra second field; shorter ones are skipped, and slashes at the end of the path do not count.
    ``test`` lines are taken as they are: a missing number fails the job, as a malformed one does in both layouts.
    """
    at = {"test": (1, 2), "train": (2, 3)}
    if layout not in at:
        raise ValueError("layout is 'test' or 'train'")
    rows = lines.filter(strip(F.col("value")) != "").select("value", F.split(strip(F.col("value")), r"\s+").alias("p"))
    path = F.get("p", F.lit(0))
    if layout == "train":
        rows, path = rows.filter(F.size("p") >= 4), F.rtrim(path, F.lit("/"))
    broken = F.raise_error(F.concat(F.lit("malformed line: "), "value")).cast("int")
    number = lambda i: F.when(F.get("p", F.lit(i)).rlike(r"^[+-]?[0-9]+$"), F.get("p", F.lit(i)).cast("int")).otherwise(broken)
    frames, label = (number(i) for i in at[layout])
    return rows.select(F.element_at(F.split(path, "/"), -1).alias("video_id"), frames.alias("n_frames"), label.alias("label"))


def read_video_list(spark: SparkSession, path: str, layout: str = "test") -> DataFrame:
    return parse_video_list(spark.read.text(path), layout)


# --- JSON ------------------------------------------------------------------------------------------------------

def read_annotations(spark: SparkSession, path: str, drop_blank: bool = False, lines: bool = False) -> DataFrame:
    """Annotation array (or JSON lines), one row per id: of several entries the last one counts. Entries without an id are
    dropped, on request also blank explanations. Both forms are read by as many tasks as the files have splits."""
    if lines:
        rows = spark.read.schema(ANNOTATION).json(path)
        rows = rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"))
    else:
        entry = F.from_json("value", ANNOTATION)
        rows = read_json_array(spark, path).select(F.struct("file", "pos").alias("place"), entry.alias("e")).select("e.*", "place")
    rest = F.struct(*[c for c in rows.columns if c not in ("video_id", "place")])
    rows = rows.filter("video_id is not null").select("video_id", rest.alias("rest"), "place")
    rows = rows.groupBy("video_id").agg(F.max_by("rest", "place").alias("a")).select("video_id", "a.*")
    return rows.filter(F.trim(F.coalesce("explanation", F.lit(""))) != "") if drop_blank else rows


def read_metadata_tree(spark: SparkSession, path: str, name: str = "metadata.json") -> DataFrame:
    """One JSON file ``name`` per recording below ``path``; frames without a file and recordings without frames are dropped.

    Segments come back with ``start_snippet`` / ``end_snippet`` whichever spelling the file used.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": name}
    rows = spark.read.schema(METADATA).options(**options).json(path, multiLine=True)

    def spelled(s: Column) -> Column:
        return F.struct(
            F.coalesce(s["start_snippet"], s["start"]).alias("start_snippet"),
            F.coalesce(s["end_snippet"], s["end"]).alias("end_snippet"),
            s["selected_snippets"].alias("selected_snippets"),
        )

    kept = F.filter("extracted_frames", lambda f: f["file"].isNotNull() & (f["file"] != ""))
    rows = rows.withColumns({"extracted_frames": kept, "anomalous_segments": F.transform("anomalous_segments", spelled)})
    return rows.filter(F.size("extracted_frames") > 0)


def read_variant_outputs(spark: SparkSession, path: str, variants: Sequence[str]) -> DataFrame:
    """Per-recording JSON files named ``<id>_<variant>.json``; the variant comes from the name."""
    rows = spark.read.schema(VARIANT_OUTPUT).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("_f"))
    return rows.withColumn("variant", variant_of(F.col("_f"), variants)).filter("variant is not null").drop("_f")


def variant_of(file_name: Column, variants: Sequence[str]) -> Column:
    """The variant that ends a file name, longest first; null when none does."""
    ordered = sorted(variants, key=len, reverse=True)
    return F.coalesce(*[F.when(F.endswith(file_name, F.lit(f"_{v}.json")), F.lit(v)) for v in ordered])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Chat manifest in JSON lines; blank lines are skipped."""
    return spark.read.schema(MANIFEST).json(path).filter("video_id is not null")


# --- sheets and listings ---------------------------------------------------------------------------------------

def usable_ratings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed cells are all non-blank."""
    for c in columns:
        df = df.filter(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df


def read_rating_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV rating sheet as numbers, ``h_*`` from people and ``g_*`` from the judge."""
    rows = usable_ratings(spark.read.csv(path, header=True), [f"human_{c} (1-5)" for c in RATINGS])
    judge = {"C": "GPT_C_HIDE_until_done", "S": "GPT_S_HIDE", "Co": "GPT_Co_HIDE", "F": "GPT_F_HIDE"}  # fixed header names
    human = [F.col(f"`human_{c} (1-5)`").cast("double").alias(f"h_{c}") for c in RATINGS]
    return rows.select(*human, *[F.col(judge[c]).cast("double").alias(f"g_{c}") for c in RATINGS])


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths of all files below ``path``, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select(folder.alias("folder"), name.alias("file"), "length")


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"(\.[^.]+)$", 1))


def frame_listing(files: DataFrame, keys: Sequence[str] = ("folder",)) -> DataFrame:
    """Images in frame order: numeric stems first, by value, then the others by name."""
    images = files.filter(extension(F.col("file")).isin(".jpg", ".jpeg", ".png", ".bmp"))
    stem = F.regexp_replace("file", r"\.[^.]+$", "")
    number = F.when(stem.rlike("^[0-9]+$"), stem.try_cast("long"))
    order = [number.isNull(), number, F.when(number.isNotNull(), extension(F.col("file"))), F.lower("file"), "file"]
    return number_by_range(images, keys, order, "pos").select(*keys, "file", "pos")


def file_inventory(files: DataFrame, examples: int = 3) -> DataFrame:
    """Files per extension with the first few names."""
    kinds = files.withColumn("ext", extension(F.col("file")))
    first = Window.partitionBy("ext").orderBy("file")
    top = kinds.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= examples)
    names = top.groupBy("ext").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file"))), lambda s: s["file"]).alias("examples"))
    return kinds.groupBy("ext").agg(F.count("*").alias("n")).join(names, "ext")


# --- checks ----------------------------------------------------------------------------------------------------

def missing_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Referenced keys that do not exist."""
    return child.select(key).distinct().join(parent.select(key), key, "left_anti")


def check_references(child: DataFrame, parent: DataFrame, key: str, show: int = 5) -> None:
    """Raise with the first few missing keys; nothing but those and the count reaches the driver."""
    missing = missing_references(child, parent, key)
    first = [r[0] for r in missing.orderBy(key).limit(show).collect()]
    if first:
        raise ValueError(f"missing {missing.count()} references, first: {first}")
