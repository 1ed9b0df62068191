"""Entries of a JSON array, read by as many tasks as the files have splits.

A split may begin anywhere: inside a string, inside a nested object. So the files are read as text records that end at ``}``,
which Spark can split at any byte, and what a record means is settled afterwards. Of each record it is known how many
quotes that are not escaped it has, and how the nesting changes in it if it begins outside or inside a string. Whether a
record does begin inside a string is the parity of all quotes before it in the file, and its nesting the sum of all
changes before it. Both are sums, so a split sums its own records, and what lies before a split comes from one row per
split. Records from the end of one entry to the end of the next are put together again, which gathers one entry, never
a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEYS = ["file", "split"]


def _nesting(text: Column) -> Column:
    """Opening less closing brackets and braces; the brace that ended the record is not in its text."""
    opened, closed = F.regexp_count(text, F.lit(r"[\[{]")), F.regexp_count(text, F.lit(r"[\]}]"))
    return opened - closed


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each closing brace, with its place: file, split (its first byte) and at (rising in the split)."""
    rows = spark.read.text(path, lineSep="}")
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    rows = rows.select(F.col("value").alias("text"), *place, F.monotonically_increasing_id().alias("at"))
    return rows.toDF("text", "file", "split", "at")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of the arrays of objects in the files of ``path``: file, pos (from 0) and value, the entry's text.

    Files whose brackets or quotes do not close fail the job, as does text between the entries; an empty array has no rows."""
    bare = F.regexp_replace("text", r"\\.", "")  # without escapes a quote always begins or ends a string
    outside = F.regexp_replace(bare, r'"[^"]*("|$)', "")
    inside = F.regexp_replace(F.regexp_replace(bare, r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")
    rows = _records(spark, path).withColumns({
        "quotes": F.regexp_count(bare, F.lit('"')).cast("long"), "from_outside": _nesting(outside).cast("long"),
        "from_inside": _nesting(inside).cast("long"),
    })
    here, before = Window.partitionBy(*_KEYS).orderBy("at"), Window.partitionBy("file").orderBy("split")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def with_earlier(rows: DataFrame, change: Column, name: str) -> DataFrame:
        """Sums of ``change`` over all records of the file before this one."""
        rows = rows.withColumn("_change", change)
        splits = rows.groupBy(*_KEYS).agg(F.sum("_change").alias("_change"))
        whole = Window.partitionBy("file")
        of_file = [F.max("split").over(whole).alias("last_split"), F.sum("_change").over(whole).alias(f"all_{name}")]
        splits = splits.select(*_KEYS, earlier("_change", before).alias("_before"), *of_file)
        found = rows.drop("last_split").join(splits, _KEYS)
        return found.withColumn(name, F.col("_before") + earlier("_change", here)).drop("_before", "_change")

    rows = with_earlier(rows, F.col("quotes"), "quoted")
    begins_inside = F.col("quoted") % 2 == 1
    ends_inside = (F.col("quoted") + F.col("quotes")) % 2 == 1
    # what follows the last brace of a file is a record too, without a brace
    last = F.lead("at").over(here).isNull() & (F.col("split") == F.col("last_split")) & F.col("text").rlike(r"\]\s*$") & ~ends_inside
    change = F.when(begins_inside, F.col("from_inside")).otherwise(F.col("from_outside"))
    rows = rows.withColumn("closes", ~ends_inside & ~last).withColumn("change", change - F.col("closes").cast("long"))
    rows = with_earlier(rows, F.col("change"), "depth")
    ends = (F.col("depth") + F.col("change") == 1) & F.col("closes")
    rows = with_earlier(rows, ends.cast("long"), "pos").withColumn("ends", ends)
    text = F.concat("text", F.when(F.col("closes") | ends_inside, "}").otherwise(""))
    closed = (F.col("all_depth") == 0) & (F.col("all_quoted") % 2 == 0)
    listed = F.array_sort(F.collect_list(F.struct("split", "at", text.alias("text"))))
    entries = rows.groupBy("file", "pos").agg(listed.alias("parts"), F.bool_or("ends").alias("whole"), F.first(closed).alias("closed"))
    joined = F.array_join(F.col("parts")["text"], "")
    entries = entries.select("file", "pos", "whole", "closed", joined.alias("text"))
    rest = F.regexp_replace("text", r"^[\s,\[\x{FEFF}]*", "")
    tail = ~F.col("whole") & ~F.col("text").rlike(r"^[\s\[\x{FEFF}]*\]\s*$") & ~F.col("text").rlike(r"^\s*$")
    broken = F.raise_error(F.concat(F.lit("not an array of objects: "), "file")).cast("string")
    found = entries.filter(F.col("whole") | tail)
    good = F.col("whole") & F.col("closed") & F.startswith(rest, F.lit("{"))
    return found.select("file", "pos", F.when(good, rest).otherwise(broken).alias("value"))
