"""Joins between runs, references and work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.functions import ids, text

from .blocks import KEY


def attach_reference(
    df: DataFrame, annotations: DataFrame, default: str, id_col: str = "video_id", type_col: str = "video_type"
) -> DataFrame:
    """Reference text: the annotation of an anomalous recording, else the fixed text. Sets the final type too."""
    known = annotations.select(id_col, F.col("explanation").alias("_ann"))
    rows = df.join(known, id_col, "left")
    hit = (F.col(type_col) == "anomalous") & F.col("_ann").isNotNull()
    return rows.withColumns({
        "reference": F.when(hit, F.col("_ann")).otherwise(F.lit(default)),
        type_col: F.when(hit, F.lit("anomalous")).otherwise(F.lit("normal_FP")),
    }).drop("_ann")


def relabel(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Manifest rows with a new label, written into every assistant turn."""
    fresh = labels.select("video_id", F.col("explanation").alias("_new"))

    def rewrite(turn: Column) -> Column:
        value = F.when(turn["from"] == "assistant", text.explanation_json(F.col("_new"))).otherwise(turn["value"])
        return F.struct(turn["from"].alias("from"), value.alias("value"))

    rows = manifest.join(fresh, "video_id")
    return rows.withColumn("conversations", F.transform("conversations", rewrite)).drop("_new")


def unlabelled(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids of the manifest that have no new label."""
    return manifest.select("video_id").distinct().join(labels.select("video_id"), "video_id", "left_anti")


def paired(a: DataFrame, b: DataFrame, id_col: str = "video_id", value: str = "overall") -> DataFrame:
    """Values of two runs on their common ids."""
    left = a.select(id_col, F.col(value).alias("value_a"))
    return left.join(b.select(id_col, F.col(value).alias("value_b")), id_col)


def pending(todo: DataFrame, done: DataFrame, id_col: str = "video_id", force: bool = False) -> DataFrame:
    """Rows still to be processed; ``force`` takes all."""
    return todo if force else todo.join(done.select(id_col), id_col, "left_anti")


def resume(todo: DataFrame, done: DataFrame, process, id_col: str = "video_id", force: bool = False) -> DataFrame:
    """Finished rows followed by the newly processed ones."""
    fresh = process(pending(todo, done, id_col, force))
    return fresh if force else done.unionByName(fresh)


def lookup(df: DataFrame, table: DataFrame, value: str, id_col: str = "video_id") -> DataFrame:
    """Attach a value that may be missing."""
    return df.join(table.select(id_col, value), id_col, "left")


def flips(base: DataFrame, run: DataFrame, keys: Sequence[str], decision: str = "detected") -> DataFrame:
    """Rows whose decision differs from the baseline (undecided differs from both answers), with the direction."""
    a = base.select(*keys, F.col(decision).alias("baseline"))
    b = run.select(*keys, F.col(decision).alias("current"))
    changed = a.join(b, list(keys)).filter(~F.col("baseline").eqNullSafe(F.col("current")))
    return changed.withColumn("direction", F.when(F.col("current"), "MISSED->DETECTED").otherwise("DETECTED->MISSED"))


def resolve_ids(names: DataFrame, targets: DataFrame, id_col: str = "video_id") -> DataFrame:
    """First match of each name: exact, lower case, clip zero-padded to four, clip without leading zeros.

    All but the exact form compare lower-cased ids. ``target`` is null when nothing matches.
    """
    name = F.col(id_col)
    forms = [name, F.lower(name), F.lower(ids.zero_padded(name)), F.lower(ids.zero_stripped(name))]
    keys = F.posexplode(F.array(*forms)).alias("priority", "key")
    asked = names.select(id_col, keys).filter("key is not null").withColumn("exact", F.col("priority") == 0)
    exact = targets.select(F.lit(True).alias("exact"), F.col(id_col).alias("key"), F.col(id_col).alias("target"))
    lower = targets.select(F.lit(False).alias("exact"), F.lower(id_col).alias("key"), F.col(id_col).alias("target"))
    hits = asked.join(exact.unionByName(lower), ["exact", "key"])
    best = hits.groupBy(id_col).agg(F.min_by("target", F.struct("priority", "target")).alias("target"))
    return names.select(id_col).distinct().join(best, id_col, "left")


def resolve_frame(frames: DataFrame, files: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Image of each frame: the three-digit name, else the four-digit name, else null."""
    names = F.array(F.format_string("%03d.jpg", "frame"), F.format_string("%04d.jpg", "frame"))
    asked = frames.select(*keys, "frame", F.posexplode(names).alias("priority", "file"))
    hits = asked.join(files.select(*keys, "file"), [*keys, "file"])
    best = hits.groupBy(*keys, "frame").agg(F.min_by("file", "priority").alias("file"))
    return frames.join(best, [*keys, "frame"], "left")


def prefer_strategy(df: DataFrame, preferred: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of the preferred strategy, or of the first strategy by name for series that lack it."""
    order = F.struct(F.col("strategy") != preferred, F.col("strategy"))
    chosen = df.groupBy(*keys).agg(F.min_by("strategy", order).alias("strategy"))
    return df.join(chosen, [*keys, "strategy"], "left_semi")


# --- id sets ---------------------------------------------------------------------------------------------------

def common_ids(a: DataFrame, b: DataFrame, id_col: str = "video_id") -> DataFrame:
    return a.select(id_col).intersect(b.select(id_col))


def except_ids(a: DataFrame, b: DataFrame, id_col: str = "video_id") -> DataFrame:
    return a.select(id_col).distinct().join(b.select(id_col), id_col, "left_anti")


def all_ids(*runs: DataFrame, id_col: str = "video_id") -> DataFrame:
    out = runs[0].select(id_col)
    for run in runs[1:]:
        out = out.union(run.select(id_col))
    return out.distinct()


def union_rows(*sources: DataFrame) -> DataFrame:
    """Rows of all sources; a column a source lacks is null."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out
