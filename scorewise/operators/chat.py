"""Prompt text and chat manifests built from tables.

A manifest row holds one recording's selected frames, so its arrays are bounded by the selection (a budget, a top-k
or a uniform sample), never by the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.functions import arrays, text

from .blocks import BLOCK_ROWS, number_rows
from .intervals import frame_score
from .sampling import hash_number, uniform_frames

IMAGE = "<image>"
SYSTEM = (
    "Stills of one camera follow, with a detector's rating between 0 (usual) and 1 (unusual) for each. "
    'Reply in JSON with a single key: {"explanation": "..."}'
)
# answers given to recordings without an anomaly, in rotation
NORMAL_LABELS = (
    "Everything seen here is everyday behaviour.",
    "Nothing out of the ordinary happens.",
    "People and vehicles move as expected throughout.",
)


def image_lines(n: Column) -> Column:
    """One placeholder line per image."""
    return F.array_join(F.array_repeat(F.lit(IMAGE), n), "\n")


def score_prompt(scores: Column) -> Column:
    return F.concat(
        F.lit("Detector ratings of the stills, earliest first: ["), text.score_text(scores, 4),
        F.lit("]\nWhat is unusual here?"),
    )


def human_turn(scores: Column) -> Column:
    return F.concat(image_lines(F.size(scores)), F.lit("\n"), score_prompt(scores))


def _turns(human: Column, label: Column) -> Column:
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.array(turn("human", human), turn("assistant", text.explanation_json(label)))


# --- prompts ---------------------------------------------------------------------------------------------------

def segment_list(segments: Column) -> Column:
    """``snippets 3-7, snippets 9-9``; ``unknown`` when there is no segment."""
    named = F.transform(segments, lambda s: F.format_string("snippets %d-%d", s["start_snippet"], s["end_snippet"]))
    return F.when(F.coalesce(F.size(segments), F.lit(0)) > 0, F.array_join(named, ", ")).otherwise(F.lit("unknown"))


def video_prompt(n_snip: Column, segments: Column, gate_score: Column, picks: Column) -> Column:
    """Description of a flagged recording from its segments, gate score and picked snippets."""
    return F.concat(
        F.lit("Recording of "), n_snip.cast("string"), F.lit(" snippets; suspicious parts: ["), segment_list(segments),
        F.lit("]; overall rating "), F.format_string("%.3f", gate_score), F.lit("; stills attached: "),
        F.size(picks).cast("string"), F.lit(", rated ["), text.labelled_score_text(picks, "snippet", 3), F.lit("]."),
    )


def segment_prompt(variant: Column, start: Column, end: Column, picks: Column) -> Column:
    """Description of one segment; ``variant`` decides whether scores and the anomaly map are mentioned.

    Variants: ``frames_only``, ``frames_plus_score``, ``frames_score_heatmap``.
    """
    with_scores = variant != "frames_only"
    scored = F.concat(F.lit(" Ratings: ["), text.labelled_score_text(picks, "frame", 2), F.lit("]."))
    mapped = F.lit(" After every still comes a map of where the rating stems from.")
    return F.concat(
        F.format_string("Excerpt from frame %d up to %d, %d in all; ", start, end, end - start),
        F.format_string("stills attached: %d.", F.size(picks)),
        F.when(with_scores, scored).otherwise(F.lit("")),
        F.when(variant == "frames_score_heatmap", mapped).otherwise(F.lit("")),
    )


def retrieval_prompt(
    queries: DataFrame, ranked: DataFrame, examples: DataFrame, per_example: int = 4, per_query: int = 12
) -> DataFrame:
    """Query id and prompt: an intro, the retrieved examples with similarity, scores and label, then the query.

    ``queries``: query_id, n_snip, gate_score, scores. ``ranked``: query_id, rank, index_id, sim. ``examples``:
    index_id, scores, label. Longer score lists are thinned uniformly.
    """
    thin = lambda s, k: arrays.take_positions(s, arrays.uniform_round(F.size(s), k))
    sim = F.when(F.col("sim").isNull(), F.lit("n/a")).otherwise(F.format_string("%.3f", F.col("sim")))
    shown = F.concat(
        F.format_string("\n[case %d, likeness ", F.col("rank")), sim, F.lit("]\n"),
        F.lit("ratings: ["), text.score_text(thin(F.col("scores"), per_example), 4),
        F.lit(']\nanswer: "'), F.col("label"), F.lit('"'),
    )
    parts = ranked.join(examples.select("index_id", "scores", "label"), "index_id").select("query_id", "rank", shown.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "part")))  # at most k rows per query
    gathered = parts.groupBy("query_id").agg(F.transform(ordered, lambda p: p["part"]).alias("parts"))
    rows = queries.join(gathered, "query_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    prompt = F.concat(
        F.format_string("Answered cases to learn from: %d. Answer the open one likewise.\n", F.size("parts")),
        F.array_join("parts", "\n"),
        F.format_string("\n\n[open case]\nsnippets: %d, ", F.col("n_snip")),
        F.format_string("overall rating: %.3f\n", F.col("gate_score")),
        F.lit("ratings: ["), text.score_text(thin(F.col("scores"), per_query), 4), F.lit("]\nanswer:"),
    )
    return rows.select("query_id", F.size("parts").alias("n_examples"), prompt.alias("prompt"))


# --- manifests -------------------------------------------------------------------------------------------------

def build_manifest(pool: DataFrame, annotations: DataFrame, max_frames: int = 16, system: str = SYSTEM) -> DataFrame:
    """Chat rows from ``(series_id, strategy, frame, score)`` and ``(series_id, explanation)``.

    Frames are thinned to ``max_frames`` by position before they are gathered, so a row stays small however many
    frames a strategy names. Recordings with a blank explanation are left out.
    """
    labels = annotations.filter(F.trim(F.coalesce("explanation", F.lit(""))) != "")
    thin = thinned(pool, max_frames)
    ordered = F.array_sort(F.collect_list(F.struct("frame", "score")))
    rows = thin.groupBy("series_id", "strategy").agg(ordered.alias("p"))
    rows = rows.join(labels.select("series_id", F.trim("explanation").alias("label")), "series_id")
    rows = rows.withColumns({
        "frame_indices": F.transform("p", lambda p: p["frame"].cast("int")), "scores": F.transform("p", lambda p: p["score"]),
    })
    vid = F.col("series_id").cast("string")
    image = lambda p, j: F.concat(
        F.lit("images/"), vid, F.lit("/"), F.col("strategy"), F.format_string("/f%03d_frm%05d.jpg", j, p["frame"])
    )
    return rows.select(
        F.concat_ws("_", vid, "strategy").alias("id"), vid.alias("video_id"), "strategy", F.lit(system).alias("system"),
        _turns(human_turn(F.col("scores")), F.col("label")).alias("conversations"),
        F.transform("p", image).alias("images"), "frame_indices", "scores",
    )


def thinned(pool: DataFrame, k: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Uniformly spaced frames of each (series, strategy), all of them when there are at most k.

    Frames are numbered block-wise and the wanted numbers joined, so no frame list is gathered first.
    """
    keys = ["series_id", "strategy"]
    slot = F.expr(f"cast(frame as bigint) div {int(size)}")
    placed = number_rows(pool, keys, ["frame"], slot, "_at")
    sizes = pool.groupBy(*keys).agg(F.count("*").alias("_n"))
    wanted = sizes.select(*keys, F.explode(arrays.uniform_round(F.col("_n"), k).cast("array<bigint>")).alias("_at"))
    return placed.join(wanted, [*keys, "_at"], "left_semi").drop("_at")


def to_messages(manifest: DataFrame, max_images: int = 16) -> DataFrame:
    """Manifest rows as role/content messages with at most ``max_images`` images; lengths must agree."""
    at = arrays.uniform_round(F.size("images"), max_images)
    agree = F.assert_true(F.size("images") == F.size("scores"), F.lit("images and scores differ in length")).isNull()
    rows = manifest.filter(agree).withColumn("_at", at)
    images, scores = arrays.take_positions(F.col("images"), F.col("_at")), arrays.take_positions(F.col("scores"), F.col("_at"))
    answer = F.get(F.filter("conversations", lambda t: t["from"] == "assistant"), F.lit(0))["value"]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(
        "id", "video_id",
        F.array(message("system", F.col("system")), message("user", human_turn(scores)), message("assistant", answer)).alias("messages"),
        images.alias("images"),
    )


def build_negatives(
    videos: DataFrame, scores: DataFrame, k: int = 5, seed: int = 42, labels: Sequence[str] = NORMAL_LABELS, system: str = SYSTEM
) -> DataFrame:
    """Chat rows of normal recordings: k uniform frames with their snippet scores, labels rotating by position.

    Position counts from 1 in the seeded order, so the second label comes first.
    """
    numbered = hash_number(videos.select("series_id", "n_frames", "n_snip"), (), ["series_id"], seed, "pos")
    shots = uniform_frames(videos, k, "round", "middle").drop("pos").join(numbered, "series_id")
    scored = frame_score(shots, scores)
    ordered = F.array_sort(F.collect_list(F.struct("frame", "score")))
    rows = scored.groupBy("series_id", "pos").agg(ordered.alias("p"))
    rows = rows.withColumns({
        "frame_indices": F.transform("p", lambda p: p["frame"].cast("int")), "scores": F.transform("p", lambda p: p["score"]),
        "label": F.get(F.array(*[F.lit(t) for t in labels]), (F.col("pos") % len(labels)).cast("int")),
    })
    vid = F.col("series_id").cast("string")
    image = lambda p: F.concat(F.lit("images/normal/"), vid, F.format_string("/f%05d.jpg", p["frame"]))
    return rows.select(
        F.concat(F.lit("normal_"), vid).alias("id"), vid.alias("video_id"), F.lit("normal").alias("video_type"),
        F.lit("uniform_sample_for_normal").alias("strategy"), F.lit(system).alias("system"),
        _turns(human_turn(F.col("scores")), F.col("label")).alias("conversations"),
        F.transform("p", image).alias("images"), "frame_indices", "scores",
    )

