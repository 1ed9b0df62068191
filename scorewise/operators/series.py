"""Score-series operators over ``(series_id, idx, score)`` rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import (
    BLOCK_ROWS, KEY, attach, disjoint_join, explode_range, halo, next_event, number_rows, range_join, solid, top_rows, with_block, with_prior,
    with_totals, within,
)

# --- smoothing and scaling -------------------------------------------------------------------------------------

def gaussian_smooth(
    df: DataFrame, range_: int, sigma: float, centered: bool = False, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS
) -> DataFrame:
    """Weighted sum over ``range_ - 1`` taps with zero padding; the kernel is not renormalised.

    The peak of the kernel sits one tap before its middle, so the result lags by one step unless ``centered``.
    Neighbours are taken by index: a missing position and a null score count as 0, a NaN makes every sum that reaches
    it NaN. A block is smoothed together with ``range_ / 2`` neighbours on each side, as one numpy convolution per
    block, with the blocks of a partition streamed in order.
    """
    if range_ % 2 or range_ < 2:
        raise ValueError("range_ must be even: an odd value changes the series length")
    half = (range_ - 1) // 2
    offset = np.arange(-half, half + 1) + (0 if centered else 1)
    kernel = np.exp(-0.5 * (offset / sigma) ** 2) / (sigma * np.sqrt(2 * np.pi))

    known = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    plain = df.select(*keys, F.col("idx").cast("long"), known)
    spread = halo(plain, keys, half, half, size=size)
    group = [*keys, "blk"]

    def starts(rows: pd.DataFrame) -> np.ndarray:
        """Positions where a new block begins in rows sorted by block."""
        fresh = np.zeros(len(rows), dtype=bool)
        fresh[:1] = True
        for c in group:
            column = rows[c].to_numpy()
            fresh[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(fresh)

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Convolve each run of rows of one block; the block a batch ends in waits for the next batch."""
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            last = int(starts(rows)[-1])
            waiting = rows.iloc[last:]
            if last:
                yield convolve(rows.iloc[:last])
        if waiting is not None:
            yield convolve(waiting)

    def convolve(rows: pd.DataFrame) -> pd.DataFrame:
        place, value, core = (rows[c].to_numpy() for c in ("idx", "score", "core"))
        smoothed = np.empty(len(rows))
        bounds = np.append(starts(rows), len(rows))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            at = place[lo:hi] - place[lo]
            padded = np.zeros(at[-1] + 1 + 2 * half)
            padded[at + half] = value[lo:hi]
            smoothed[lo:hi] = np.correlate(padded, kernel, "valid")[at]
        # a NaN sent back from pandas would arrive as null
        return rows.assign(score=smoothed, undefined=np.isnan(smoothed))[core][[*keys, "idx", "score", "undefined"]]

    ordered = spread.repartition(*group).sortWithinPartitions(*group, "idx")
    smoothed = ordered.mapInPandas(smooth, T.StructType([
        *plain.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("undefined", T.BooleanType())
    ]))
    score = F.when(F.col("undefined"), float("nan")).otherwise(F.col("score"))
    return smoothed.select(*keys, "idx", score.alias("score"))


def minmax(df: DataFrame, mode: str = "keep", keys: Sequence[str] = KEY, size: int = BLOCK_ROWS) -> DataFrame:
    """Scale each series to [0, 1].

    ``keep``: a series with range below 1e-8 stays as it is. ``zero``: it becomes 0. ``eps``: denominator plus
    1e-8. ``relu``: bounds are floored at 0, the result is clipped to [0, 1].
    """
    score = F.col("score")
    rows = with_totals(with_block(df, size=size), keys, _lo=("min", score), _hi=("max", score))
    lo, hi = F.col("_lo"), F.col("_hi")
    if mode == "keep":
        scaled = F.when(hi - lo < 1e-8, score).otherwise((score - lo) / (hi - lo))
    elif mode == "zero":
        scaled = F.when(hi == lo, F.lit(0.0)).otherwise(F.nanvl((score - lo) / (hi - lo), F.lit(0.0)))
    elif mode == "eps":
        scaled = (score - lo) / (hi - lo + 1e-8)
    elif mode == "relu":
        lo, hi = F.greatest(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
        delta = F.when(hi - lo <= 0, F.lit(1.0)).otherwise(hi - lo)
        scaled = F.greatest(F.least((score - lo) / delta, F.lit(1.0)), F.lit(0.0))
    else:
        raise ValueError("mode is keep, zero, eps or relu")
    return rows.withColumn("score", scaled).select(*df.columns)


# --- segments --------------------------------------------------------------------------------------------------

def _runs(df: DataFrame, event: Column, keys: Sequence[str], size: int, numbered: bool = True) -> DataFrame:
    """Maximal runs of state 1, both ends inclusive, with the block of the end; ``numbered`` from 0 per key.

    ``event`` is 1 (enter), 0 (leave) or null (keep the state). One summary row per block tells each block the
    state it starts in and the event that follows it, so the first and last row of every run are recognised inside
    the block. A last row then takes the latest first row, its own block's or an earlier one's, as its start, and the
    count of first rows up to there as its number.
    """
    rows = with_block(df.select(*keys, F.col("idx").cast("long"), event.alias("ev")), size=size)
    rows = solid(rows, keys).repartition(*keys, "blk")  # one exchange of the rows, shared by everything below

    per_block = rows.groupBy(*keys, "blk").agg(
        F.max_by("ev", F.when(F.col("ev").isNotNull(), F.col("idx"))).alias("last_ev"),
        F.struct(F.min_by("ev", "idx").alias("ev")).alias("first"),
    )
    ordered = Window.partitionBy(*keys).orderBy("blk")
    carried = per_block.select(
        *keys, "blk",
        F.last("last_ev", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.lead("first").over(ordered).alias("following"),
    )

    in_order = within(keys, "idx")
    state = F.coalesce(F.last("ev", ignorenulls=True).over(in_order), "carry", F.lit(0))
    before = F.coalesce(F.lag("state").over(in_order), "carry", F.lit(0))
    # a following block whose first row has no event keeps this block's state; no following block ends the run
    beyond = F.when(F.col("following").isNull(), 0).otherwise(F.coalesce("following.ev", "state"))
    after = F.coalesce(F.lead("state").over(in_order), beyond)
    ends = (
        rows.join(carried, [*keys, "blk"])
        .withColumn("state", state)
        .select(*keys, "blk", "idx", "state", before.alias("before"), after.alias("after"))
        .filter("state = 1 and (before = 0 or after = 0)")
        .select(*keys, "blk", "idx", (1 - F.col("before")).alias("opens"), (1 - F.col("after")).alias("closes"))
    )
    opening = F.when(F.col("opens") == 1, F.col("idx"))
    folds = {"opened": ("sum", F.col("opens"))} if numbered else {}
    placed = with_prior(ends, keys, **folds, opened_at=("max", opening))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    number = [(F.coalesce("opened", F.lit(0)) + F.sum("opens").over(so_far) - 1).alias("seg_no")] if numbered else []
    start = F.coalesce(F.max(opening).over(so_far), "opened_at")
    placed = placed.select(*keys, "blk", *number, start.alias("start_idx"), F.col("idx").alias("end_idx"), "closes")
    return placed.filter("closes = 1").drop("closes")


def threshold_runs(df: DataFrame, tau: float | Column, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS) -> DataFrame:
    """Runs of ``score > tau``; ``end_idx`` is **inclusive**. NaN and null keep the current state."""
    known = F.col("score").isNotNull() & ~F.isnan("score")
    event = F.when(known & (F.col("score") > tau), 1).when(known, 0)
    return _runs(df, event, keys, size).drop("blk")


def hysteresis_segments(
    df: DataFrame, hi: float = 0.5, lo: float = 0.3, min_len: int = 8, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS
) -> DataFrame:
    """Enter above ``hi``, leave below ``lo``, drop runs shorter than ``min_len``; ``end_idx`` is **exclusive**."""
    if hi < lo:
        raise ValueError("hi must not be below lo")
    known = F.col("score").isNotNull() & ~F.isnan("score")
    event = F.when(known & (F.col("score") > hi), 1).when(known & (F.col("score") < lo), 0)
    runs = _runs(df, event, keys, size, numbered=False).withColumn("end_idx", F.col("end_idx") + 1)
    long = runs.filter(F.col("end_idx") - F.col("start_idx") >= min_len)
    # numbered once, in the blocks of the ends, where the runs already lie
    return number_rows(long, keys, ["start_idx"], F.col("blk"), "seg_no").select(*keys, "seg_no", "start_idx", "end_idx")


def segment_summary(
    df: DataFrame, segments: DataFrame, end: str = "inclusive", keys: Sequence[str] = KEY, size: int = BLOCK_ROWS
) -> DataFrame:
    """Start, end (same convention as the input), length, mean and max score of each segment; segments of a series must
    not overlap."""
    shift = {"inclusive": 0, "exclusive": 1}[end]
    spans = segments.select(*keys, "seg_no", "start_idx", (F.col("end_idx") - shift).alias("_last"))
    rows = disjoint_join(df.select(*keys, "idx", "score"), spans, keys, hi="_last", size=size)
    return rows.groupBy(*keys, "seg_no").agg(
        F.first("start_idx").alias("start_idx"),
        (F.first("_last") + shift).alias("end_idx"),
        (F.first("_last") - F.first("start_idx") + 1).alias("length"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
    )


def segment_mean_max(series: DataFrame, summary: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Series score: the largest segment mean, 0 for a series without a segment."""
    best = summary.groupBy(*keys).agg(F.max("mean_score").alias("_best"))
    scored = series.join(best, list(keys), "left")
    return scored.withColumn("segment_mean_max", F.coalesce("_best", F.lit(0.0))).drop("_best")


def first_segment(segments: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The earliest segment of each series."""
    rest = [c for c in segments.columns if c not in (*keys, "seg_no")]
    picked = segments.groupBy(*keys).agg(F.min_by(F.struct("seg_no", *rest), "seg_no").alias("s"))
    return picked.select(*keys, "s.*")


# --- gates and decisions ---------------------------------------------------------------------------------------

def gate(df: DataFrame, tau: float = 0.2, score: str = "gate_score") -> DataFrame:
    """Strict gate: flagged iff the score is above ``tau``."""
    return df.withColumn("flagged", F.col(score) > tau)


def decide(df: DataFrame, threshold: float | Column, score: str = "video_score") -> DataFrame:
    """Inclusive decision: 1 iff the score reaches the threshold."""
    return df.withColumn("prediction", F.when(F.col(score) >= threshold, 1).otherwise(0))


def max_gate(df: DataFrame, threshold: float, normal_text: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Per series: detected iff the maximum reaches the threshold; others get the fixed answer."""
    top = df.groupBy(*keys).agg(F.max("score").alias("max_score"))
    detected = F.col("max_score") >= threshold
    return top.select("*", detected.alias("detected"), F.when(~detected, F.lit(normal_text)).alias("explanation"))


# --- whole-series summaries ------------------------------------------------------------------------------------

def series_mean(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("full_mean"))


def topk_mean(df: DataFrame, k: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean of the k largest scores of each series, k clamped to the series length."""
    return top_rows(df, keys, max(1, k)).groupBy(*keys).agg(F.avg("score").alias("topk_mean"))


def topk_span(df: DataFrame, budget: int, keys: Sequence[str] = KEY) -> DataFrame:
    """One pseudo-segment from the first to the last of the ``budget`` best positions (inclusive)."""
    return top_rows(df, keys, budget).groupBy(*keys).agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"))


def series_summary(df: DataFrame, tau: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Length, mean, population deviation, maximum, 1-based first argmax and share above ``tau``."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.max("score").alias("max_score"),
        (F.max_by("idx", F.struct(F.col("score"), -F.col("idx"))) + 1).alias("argmax_1based"),
        F.avg((F.col("score") > tau).cast("double")).alias("frac_above"),
    )


def series_roughness(df: DataFrame, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS) -> DataFrame:
    """Sum of squared steps and Euclidean size of each series."""
    copies = halo(df.select(*keys, "idx", "score"), keys, after=1, size=size)
    step = F.lead("score").over(within(keys, "idx")) - F.col("score")
    rows = copies.withColumn("_step", step).filter("core")
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("_step") * F.col("_step")), F.lit(0.0)).alias("roughness"),
        F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("l2_size"),
    )


def position_profile(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean and population deviation per position; empty when the series differ in length."""
    lengths = df.groupBy(*keys).agg(F.count("*").alias("n"))
    aligned = lengths.agg((F.min("n") == F.max("n")).alias("same")).scalar()
    profile = df.groupBy("idx").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    return profile.withColumn("_same", aligned).filter("_same").drop("_same")


def score_histogram(df: DataFrame, bins: int = 40, label: str = "label", score: str = "score") -> DataFrame:
    """Equal-width counts per class over that class's own range; the last bin is closed on the right."""
    bounds = df.groupBy(label).agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("_b"))
    rows = attach(df, bounds, [label], F.col(score))
    width = F.col("_b.hi") - F.col("_b.lo")
    place = F.floor((F.col(score) - F.col("_b.lo")) / width * bins)
    rows = rows.withColumn("bin", F.when(width > 0, F.least(place, F.lit(bins - 1))).otherwise(F.lit(bins // 2)))
    return rows.groupBy(label, "bin").agg(F.count("*").alias("n"))


# --- neighbourhood windows -------------------------------------------------------------------------------------

def centered_absdiff(
    df: DataFrame, step: int, edge: str = "self", keys: Sequence[str] = KEY, size: int = BLOCK_ROWS
) -> DataFrame:
    """``|x[i-step] - x[i+step]|``; a missing side is the row itself or the first / last row of the series."""
    rows = df.select(*keys, "idx", "score")
    if edge == "clamp":
        first = F.when(F.col("idx") == 0, F.col("score"))
        rows = with_totals(with_block(rows, size=size), keys, _first=("max", first), _n=("count", F.lit(1))).drop("blk")
        tail = rows.filter(F.col("idx") == F.col("_n") - 1).select(*keys, F.col("score").alias("_last"))
        rows = _attach_per_series(rows, tail, keys, size)
        fill_lo, fill_hi = F.col("_first"), F.col("_last")
    elif edge == "self":
        fill_lo = fill_hi = F.col("score")
    else:
        raise ValueError("edge is 'self' or 'clamp'")
    w = within(keys, "idx")
    copies = halo(rows, keys, step, step, size=size)
    diff = F.abs(F.coalesce(F.lag("score", step).over(w), fill_lo) - F.coalesce(F.lead("score", step).over(w), fill_hi))
    return copies.withColumn("absdiff", diff).filter("core").select(*keys, "idx", "absdiff")


def _attach_per_series(rows: DataFrame, per_series: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Join one small row per series onto rows that carry ``_n``, spread over the blocks of the series."""
    blocks = with_block(rows, size=size)
    listed = blocks.groupBy(*keys, "blk").agg(F.lit(1).alias("_one")).join(per_series, list(keys)).drop("_one")
    return blocks.join(listed, [*keys, "blk"]).drop("blk")


def rolling_meter(df: DataFrame, n: int = 20, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS) -> DataFrame:
    """Lower median, mean, maximum and latest value over the last ``n`` rows, and the mean over all rows so far."""
    copies = halo(df.select(*keys, "idx", "score"), keys, before=n - 1, size=size)
    own = F.when(F.col("core"), F.col("score"))
    copies = with_prior(copies, keys, _sum=("sum", own), _cnt=("count", own))
    recent = within(keys, "idx").rowsBetween(-(n - 1), 0)
    so_far = within(keys, "idx").rowsBetween(Window.unboundedPreceding, 0)
    values = F.array_sort(F.collect_list("score").over(recent))
    total = F.coalesce("_sum", F.lit(0.0)) + F.sum(own).over(so_far)
    count = F.coalesce("_cnt", F.lit(0)) + F.count(own).over(so_far)
    meter = copies.select(
        *keys, "idx", "core",
        F.element_at(values, F.floor((F.size(values) + 1) / 2).cast("int")).alias("median"),
        F.avg("score").over(recent).alias("mean"),
        F.max("score").over(recent).alias("max"),
        F.col("score").alias("value"),
        (total / count).alias("global_mean"),
    )
    return meter.filter("core").drop("core")


def running_best(
    df: DataFrame, after: int = 200, every: int = 5, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS
) -> DataFrame:
    """Evaluations after step ``after`` at every ``every``-th step, flagged when they beat all earlier ones."""
    evals = df.filter((F.col("idx") > after) & (F.col("idx") % every == 0)).select(*keys, "idx", "score")
    rows = with_prior(with_block(evals, size=size), keys, _earlier=("max", F.col("score")))
    here = F.max("score").over(within(keys, "idx").rowsBetween(Window.unboundedPreceding, -1))
    best = F.coalesce(F.greatest(here, "_earlier"), F.lit(-1.0))  # greatest skips nulls
    return rows.select(*keys, "idx", "score", (F.col("score") > best).alias("is_best"))


# --- frames ----------------------------------------------------------------------------------------------------

def clip_windows(videos: DataFrame, length: int = 16, keys: Sequence[str] = KEY) -> DataFrame:
    """``max(1, n div length)`` clips of each recording; a tail is dropped, a single short clip is padded."""
    n = F.col("n_frames")
    clips = explode_range(videos.select(*keys, "n_frames"), F.greatest(F.lit(1), F.floor(n / length)), keys, "clip")
    start = F.col("clip") * length
    end = F.least(start + length, n)
    return clips.select(
        *keys, "clip", start.alias("start_frame"), end.alias("end_frame"), (start + length - end).alias("n_pad")
    )


def take_while(
    frames: DataFrame, tracks: DataFrame, limit: float = 800, value: str = "size", keys: Sequence[str] = KEY,
) -> DataFrame:
    """Frames of each track ``[start_idx, end_idx)`` up to, not including, the first with ``value < limit``."""
    spans = tracks.select(*keys, "track_no", "start_idx", (F.col("end_idx") - 1).alias("_last"))
    small = frames.filter(F.col(value) < limit).select(*keys, "idx")
    kept = next_event(spans, small, keys, name="_stop")
    kept = kept.withColumn("_last", F.least(F.col("_stop") - 1, F.col("_last"))).drop("_stop")
    rows = range_join(frames.select(*keys, "idx", value), kept, keys, hi="_last")
    return rows.select(*keys, "track_no", "idx", value)
