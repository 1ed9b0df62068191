"""Stand-in tables derived from the driver tables, once as DataFrames and once as SQL.

Every stand-in uses the whole table it is derived from.
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.operators.blocks import number_by_range

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scores`` with the frame label of each row."""

    events = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "value", "event_type"
    )
    return number_by_range(events, ["user_id"], ["ts", "event_id"]).select(
        F.col("user_id").alias("series_id"), "idx", (F.col("value") / (F.col("value") + 50.0)).alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_scores(spark, sf_dir).select("series_id", "idx", "score")


def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_scores(spark, sf_dir).select("series_id", F.col("idx").alias("frame"), "label")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_user = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("series_id")).agg(
        F.count("*").alias("n_snip")
    )
    return per_user.select(
        "series_id", "n_snip",
        (F.col("n_snip") * 16 + F.col("series_id") % 16).alias("n_frames"),
        F.when(F.col("series_id") % 5 == 0, 1).otherwise(0).alias("label"),
        (F.col("series_id") % 13).alias("scene"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = frame_labels(spark, sf_dir).filter((F.col("label") == 1) & (F.col("series_id") % 3 == 0))
    return hits.groupBy("series_id").agg(
        (F.min("frame") * 16).alias("start_frame"), (F.max("frame") * 16 + 15).alias("end_frame")
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("series_id"), (F.col("vec_id") % 10).alias("idx"),
        F.col("embedding").alias("vec"), "label",
    )


def _ratings(correctness):
    d, n = F.col("doc_id"), F.col("n_chars")
    return [
        correctness.cast("int").alias("correctness"),
        (1 + d % 5).cast("int").alias("specificity"),
        (1 + F.expr("n_chars div 7") % 5).cast("int").alias("completeness"),
        (3 + F.col("quality")).cast("int").alias("fluency"),
    ]


def _judged(spark: SparkSession, sf_dir: str, correctness) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("video_id"),
        F.when(F.col("toxic") == 1, "anomalous").otherwise("normal_FP").alias("video_type"),
        F.col("source").alias("scene"),
        *_ratings(correctness),
        F.when(F.col("doc_id") % 23 == 0, F.lit("ERROR: timeout")).otherwise(F.col("text")).alias("text"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, F.when(F.col("doc_id") % 17 != 0, 1 + F.col("n_chars") % 5))


def judged_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _judged(spark, sf_dir, 1 + (F.col("n_chars") + F.col("doc_id")) % 5)
    return run.filter(F.col("video_id") % 11 != 0)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest turns of each conversation: the system text, the first user and the first assistant turn.

    First turns are picked by an aggregate, so a conversation of any length stays in partial sums.
    """
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        first("system").alias("system"), first("user").alias("human"), first("assistant").alias("answer")
    )
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), F.coalesce(value, F.lit("")).alias("value"))
    return rows.select(
        F.col("conv_id").alias("video_id"), F.coalesce("system", F.lit("")).alias("system"),
        F.array(turn("human", F.col("human")), turn("assistant", F.col("answer"))).alias("conversations"),
    )


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", *order)
    return number_by_range(items, ["l_suppkey"], order).select(
        F.col("l_suppkey").alias("series_id"), "idx",
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + 50000.0)).alias("score"),
    )


_RUN = """select d.doc_id video_id, case when toxic=1 then 'anomalous' else 'normal_FP' end video_type, source scene,
 {correctness} correctness, 1+doc_id%5 specificity, 1+(n_chars//7)%5 completeness, 3+quality fluency,
 case when doc_id%23=0 then 'ERROR: timeout' else text end as text
 from documents d left join labels using (doc_id)"""

_VIEWS = {
    "numbered": "select user_id series_id, row_number() over (partition by user_id order by ts, event_id)-1 idx,"
    " value/(value+50.0) score, case when event_type='error' then 1 else 0 end as label from events",
    "scores": "select series_id, idx, score from numbered",
    "frame_labels": "select series_id, idx frame, label from numbered",
    "videos": "select user_id series_id, count(*) n_snip, count(*)*16 + user_id%16 n_frames,"
    " case when user_id%5=0 then 1 else 0 end as label, user_id%13 scene from events group by user_id",
    "annotations": "select series_id, min(frame)*16 start_frame, max(frame)*16+15 end_frame from frame_labels"
    " where label=1 and series_id%3=0 group by series_id",
    "features": "select vec_id//10 series_id, vec_id%10 idx, embedding vec, label from embeddings",
    "judged": _RUN.format(correctness="case when doc_id%17<>0 then 1+n_chars%5 end"),
    "judged_b": _RUN.format(correctness="1+(n_chars+doc_id)%5") + " where doc_id%11<>0",
    "bench": "select l_suppkey series_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber,"
    " l_partkey, l_extendedprice)-1 idx, l_extendedprice/(l_extendedprice+50000.0) score from lineitem",
}
_ORDER = list(_VIEWS)


def sql(body: str, **extra: str) -> str:
    """Prefix ``body`` with the stand-in views it names, and with ``extra`` named steps in the given order."""
    text = " ".join([body, *extra.values()])
    needed: set[str] = set()
    for name in reversed(_ORDER):
        if re.search(rf"\b{name}\b", text + " " + " ".join(_VIEWS[n] for n in needed)):
            needed.add(name)
    steps = [f"{n} as ({_VIEWS[n]})" for n in _ORDER if n in needed] + [f"{n} as ({q})" for n, q in extra.items()]
    return ("with recursive " + ",\n".join(steps) + "\n" if steps else "") + body
