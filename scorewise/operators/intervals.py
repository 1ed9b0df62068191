"""Interval logic between snippet grids, annotations and dense labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewise.functions import frames

from .blocks import BLOCK_ROWS, KEY, disjoint_join, explode_range, range_join

_NEAR = 2


def _near(guess: Column) -> Column:
    """Candidate snippet indices around an estimate, clipped to the grid; the exact test picks among them."""
    at = F.least(F.greatest(guess.cast("long"), F.lit(0)), F.col("n_snip") - 1)
    return F.sequence(F.greatest(at - _NEAR, F.lit(0)), F.least(at + _NEAR, F.col("n_snip") - 1))


def overlap_windows(annotations: DataFrame, series: DataFrame) -> DataFrame:
    """Snippet index range ``start_idx..end_idx`` (inclusive) that overlaps each annotated frame interval.

    Snippet bounds rise with the index, so the overlapping snippets are one range and are found from the
    annotation alone, without touching snippet rows. Both are null when nothing overlaps.
    """
    n_frames, n_snip = F.col("n_frames"), F.col("n_snip")
    spans = annotations.join(series.select("series_id", "n_frames", "n_snip"), "series_id")
    spans = spans.filter((n_frames > 0) & (n_snip > 0))
    reach_lo = F.filter(
        _near(F.col("start_frame") * n_snip / n_frames),
        lambda i: frames.snippet_hi(i, n_frames, n_snip) >= F.col("start_frame"),
    )
    reach_hi = F.filter(
        _near(F.ceil((F.col("end_frame") + 1) * n_snip / n_frames) - 1),
        lambda i: frames.snippet_lo(i, n_frames, n_snip) <= F.col("end_frame"),
    )
    spans = spans.withColumns({"_lo": F.array_min(reach_lo), "_hi": F.array_max(reach_hi)})
    found = F.col("_lo") <= F.col("_hi")
    return spans.withColumns(
        {"start_idx": F.when(found, F.col("_lo")), "end_idx": F.when(found, F.col("_hi"))}
    ).drop("_lo", "_hi")


def _nearest() -> Column:
    n_frames, n_snip = F.col("n_frames"), F.col("n_snip")
    centre = F.floor((F.col("start_frame") + F.col("end_frame")) / 2)

    def distance(i: Column) -> Column:
        lo, hi = frames.snippet_lo(i, n_frames, n_snip), frames.snippet_hi(i, n_frames, n_snip)
        away = F.when(centre < lo, lo - centre).when(centre > hi, centre - hi).otherwise(0)
        return F.struct(away.cast("long").alias("away"), i.cast("long").alias("idx"))

    # on a grid finer than the frames several snippets share a frame: the lowest of them is listed
    clipped = F.least(F.greatest(centre, F.lit(0)), n_frames - 1)
    return F.array_min(F.transform(_near(F.ceil(clipped * n_snip / n_frames)), distance))["idx"]


def nearest_snippet(annotations: DataFrame, series: DataFrame) -> DataFrame:
    """Snippet whose frame range is closest to the centre of each annotation; ties go to the lower index."""
    spans = annotations.join(series.select("series_id", "n_frames", "n_snip"), "series_id")
    return spans.filter("n_frames > 0 and n_snip > 0").withColumn("idx", _nearest())


def annotated_windows(annotations: DataFrame, series: DataFrame) -> DataFrame:
    """Overlapping snippet range of each annotation, or its nearest snippet when nothing overlaps."""
    windows = overlap_windows(annotations, series)
    return windows.withColumns({
        "start_idx": F.coalesce("start_idx", _nearest()), "end_idx": F.coalesce("end_idx", _nearest()),
    })


def overlap_join(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Snippet rows inside the windows, with the window's columns."""
    return range_join(df, windows.filter(F.col("start_idx").isNotNull()))


def span_to_snippets(annotations: DataFrame, series: DataFrame) -> DataFrame:
    """Frame span -> snippet index range by proportion, clamped and put in order."""
    per = F.col("n_frames") / F.col("n_snip")
    top = F.col("n_snip") - 1

    def snippet(frame: str) -> Column:
        inside = F.greatest(F.lit(0), F.least((F.col(frame) / per).cast("long"), top))
        return inside

    spans = annotations.join(series.select("series_id", "n_frames", "n_snip"), "series_id")
    a, b = snippet("start_frame"), snippet("end_frame")
    empty = F.col("n_frames") <= 0
    return spans.select(
        "series_id",
        F.when(empty, 0).otherwise(F.least(a, b)).alias("snip_lo"),
        F.when(empty, F.greatest(F.lit(0), top)).otherwise(F.greatest(a, b)).alias("snip_hi"),
    )


def label_span(labels: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """First and last positive frame of each series; null for a series without one."""
    hit = F.when(F.col("label") > 0, F.col("frame"))
    return labels.groupBy(*keys).agg(F.min(hit).alias("start_frame"), F.max(hit).alias("end_frame"))


def intervals_to_labels(videos: DataFrame, spans: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Dense 0/1 label per frame from inclusive frame intervals, clamped to the recording.

    Intervals are cut at block borders and merged inside each block. A block of a recording is then a list of runs of equal
    labels, joined as one row, and its frames are made from those: no frame is shuffled or sorted.
    """
    bounds = f"sequence(cast(greatest(start_frame, 0) as bigint) div {size}, cast(end_frame as bigint) div {size})"
    pieces = spans.filter("start_frame <= end_frame and end_frame >= 0").withColumn("blk", F.explode(F.expr(bounds)))
    pieces = pieces.select(
        "series_id", "blk",
        F.greatest(F.col("start_frame"), F.col("blk") * size).alias("lo"),
        F.least(F.col("end_frame"), F.col("blk") * size + size - 1).alias("hi"),
    )
    w = Window.partitionBy("series_id", "blk").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("lo") <= F.col("reach") + 1, 0).otherwise(1)
    merged = (
        pieces.withColumn("reach", reach)
        .withColumn("run", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("series_id", "blk", "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    held = merged.groupBy("series_id", "blk").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    blocks = videos.select("series_id", F.col("n_frames").cast("long").alias("n_frames")).filter("n_frames > 0")
    blocks = blocks.withColumn("blk", F.explode(F.expr(f"sequence(0L, (n_frames - 1) div {size})")))
    blocks = blocks.withColumns({"first": F.col("blk") * size, "last": F.least((F.col("blk") + 1) * size, "n_frames") - 1})
    met = blocks.join(held, ["series_id", "blk"], "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")))
    ones = F.expr("transform(spans, s -> named_struct('lo', s.lo, 'hi', least(s.hi, last), 'label', 1))")
    zeros = F.expr(
        "transform(sequence(0, size(spans)), i -> named_struct('lo', if(i = 0, first, element_at(spans, i).hi + 1),"
        " 'hi', if(i = size(spans), last, least(get(spans, i).lo - 1, last)), 'label', 0))"
    )
    # a fixed count, as in ``explode_range``: what is spread are a few numbers per block
    tasks = int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = met.repartition(tasks, "series_id", "blk").select("series_id", F.inline(F.concat(ones, zeros))).filter("lo <= hi")
    return spread.select("series_id", F.explode(F.sequence("lo", "hi")).alias("frame"), "label")


def align_labels(
    labels: DataFrame, series: DataFrame | None = None, pad: str = "zero", clip: int = frames.CLIP, size: int = BLOCK_ROWS
) -> DataFrame:
    """Cut or extend dense labels to whole clips.

    ``zero``: to ``max(1, n div clip)`` clips, a short recording is filled with 0. ``last``: to the ``n_snip`` clips
    of ``series``, filled with the recording's last label.
    """
    labels = labels.select("series_id", F.col("frame").cast("long"), "label")
    ends = labels.groupBy("series_id").agg(F.count("*").alias("_n"), F.max_by("label", "frame").alias("_last"))
    if pad == "zero":
        ends = ends.withColumn("_want", F.greatest(F.lit(1), F.expr(f"_n div {clip}")) * clip)
        fill = F.lit(0)
    elif pad == "last":
        if series is None:
            raise ValueError("pad='last' needs the series with n_snip")
        ends = ends.join(series.select("series_id", (F.col("n_snip") * clip).alias("_want")), "series_id")
        fill = F.col("_last")
    else:
        raise ValueError("pad is 'zero' or 'last'")
    whole = ends.select("series_id", F.lit(0).cast("long").alias("_from"), (F.col("_want") - 1).alias("_to"))
    kept = disjoint_join(labels, whole, KEY, "frame", "_from", "_to", size=size).select("series_id", "frame", "label")
    short = ends.filter("_want > _n")
    added = explode_range(short, F.col("_want") - F.col("_n"), KEY, "_more", size)
    added = added.select("series_id", (F.col("_n") + F.col("_more")).alias("frame"), fill.cast("int").alias("label"))
    return kept.unionByName(added)


def expand_snippets(df: DataFrame, clip: int = frames.CLIP) -> DataFrame:
    """One row per frame of each snippet."""
    offsets = F.explode(F.sequence(F.lit(0), F.lit(clip - 1)))
    rows = df.withColumn("_at", offsets)
    return rows.select("series_id", (F.col("idx") * clip + F.col("_at")).alias("frame"), "score")


def temporal_iou(annotations: DataFrame, segments: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """IoU of each series' first segment with its annotation; lengths are ``end - start``, touching gives 0.

    ``annotations`` and ``segments`` carry start_frame / end_frame; ``series`` lists the series to report.
    """
    ids = (series if series is not None else annotations).select("series_id")
    gt = annotations.select("series_id", F.col("start_frame").alias("gt_start"), F.col("end_frame").alias("gt_end"))
    first = segments.groupBy("series_id").agg(
        F.count("*").alias("num_segments"), F.min_by(F.struct("start_frame", "end_frame"), "seg_no").alias("d")
    )
    rows = ids.join(gt, "series_id", "left").join(first, "series_id", "left")
    start, end = F.col("d.start_frame"), F.col("d.end_frame")
    both = F.col("gt_start").isNotNull() & start.isNotNull()
    overlap = F.greatest(F.least("gt_end", end) - F.greatest("gt_start", start), F.lit(0))
    union = (F.col("gt_end") - F.col("gt_start")) + (end - start) - overlap
    return rows.select(
        "series_id", "gt_start", "gt_end", start.alias("detected_start"), end.alias("detected_end"),
        F.coalesce("num_segments", F.lit(0)).alias("num_segments"),
        F.when(both & (union > 0), overlap / union).otherwise(0.0).alias("temporal_iou"),
    )


def frame_score(frame_rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Score of the snippet each frame falls in. ``frame_rows`` carry n_frames and n_snip."""
    idx = frames.frame_to_snippet(F.col("frame"), F.col("n_frames"), F.col("n_snip"))
    return frame_rows.withColumn("idx", idx).join(scores.select("series_id", "idx", "score"), ["series_id", "idx"])

