"""Snippet and frame arithmetic. F is the frame count, T the snippet count of a recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 16


def snippet_lo(i: Column, n_frames: Column, n_snip: Column) -> Column:
    return F.floor(i * n_frames / n_snip).cast("long")


def snippet_hi(i: Column, n_frames: Column, n_snip: Column) -> Column:
    """Last frame of the snippet (inclusive), never before its first."""
    last = F.least(n_frames - 1, F.floor((i + 1) * n_frames / n_snip).cast("long") - 1)
    return F.greatest(last, snippet_lo(i, n_frames, n_snip)).cast("long")


def snippet_mid(i: Column, n_frames: Column, n_snip: Column) -> Column:
    """Middle of the snippet's own inclusive frame range."""
    return F.floor((snippet_lo(i, n_frames, n_snip) + snippet_hi(i, n_frames, n_snip)) / 2).cast("long")


def snippet_mid_frame(i: Column, n_frames: Column, n_snip: Column) -> Column:
    """Start of the snippet plus half the mean snippet length, clamped to the last frame."""
    per = n_frames / n_snip
    return F.least((i * per).cast("long") + (per / 2).cast("long"), n_frames - 1).cast("long")


def frame_to_snippet(frame: Column, n_frames: Column, n_snip: Column) -> Column:
    return F.least(n_snip - 1, (frame / F.greatest(n_frames, F.lit(1)) * n_snip).cast("long")).cast("long")


def topk_frame(i: Column, n_frames: Column, n_raw: Column, pooled: int = 32) -> Column:
    """Frame of a snippet of the pooled series, mapped back to the raw snippet grid."""
    raw = (i * (n_raw / F.lit(float(pooled)))).cast("long")
    return F.least(raw * CLIP + CLIP // 2, n_frames - 1).cast("long")
