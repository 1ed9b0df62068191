"""Ids carry meaning: ``scene_clip``; a four-character clip marks an anomalous recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scene_id(video_id: Column) -> Column:
    """Text before the first underscore."""
    return F.split_part(video_id, F.lit("_"), F.lit(1))


def clip_id(video_id: Column) -> Column:
    """Second underscore-separated part, or the whole id when it has no underscore."""
    return F.when(F.instr(video_id, "_") > 0, F.split_part(video_id, F.lit("_"), F.lit(2))).otherwise(video_id)


def video_type(video_id: Column, annotated: Column | None = None) -> Column:
    """``anomalous`` for four-character clips (that are also annotated, when given), else ``normal_FP``."""
    hit = F.length(clip_id(video_id)) == 4
    if annotated is not None:
        hit = hit & F.coalesce(annotated, F.lit(False))
    return F.when(hit, F.lit("anomalous")).otherwise(F.lit("normal_FP"))


def is_anomalous_clip(video_id: Column) -> Column:
    """Strict form: two digits, underscore, exactly four digits."""
    return video_id.rlike(r"^[0-9]{2}_[0-9]{4}$")


def feature_id(path: Column) -> Column:
    """Base name without ``.npy`` and without ``_i3d``."""
    base = F.element_at(F.split(F.trim(path), "/"), -1)
    return F.replace(F.replace(base, F.lit(".npy")), F.lit("_i3d"))


def zero_padded(video_id: Column, width: int = 4) -> Column:
    """``01_074`` -> ``01_0074``; null unless the id has exactly two parts. Never truncates."""
    clip = F.split_part(video_id, F.lit("_"), F.lit(2))
    padded = F.when(F.length(clip) >= width, clip).otherwise(F.lpad(clip, width, "0"))
    return F.when(_two_parts(video_id), F.concat_ws("_", scene_id(video_id), padded))


def zero_stripped(video_id: Column) -> Column:
    """``01_0074`` -> ``01_74``; an all-zero clip becomes ``0``."""
    clip = F.ltrim(F.split_part(video_id, F.lit("_"), F.lit(2)), F.lit("0"))
    clip = F.when(clip == "", F.lit("0")).otherwise(clip)
    return F.when(_two_parts(video_id), F.concat_ws("_", scene_id(video_id), clip))


def _two_parts(video_id: Column) -> Column:
    return F.size(F.split(video_id, "_")) == 2
