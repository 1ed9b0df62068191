"""Budgeted, uniform, stratified and seeded selection.

Seeded orders are defined by ``md5(seed:id)``: the same rows are picked on any cluster and by any SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewise.functions import arrays, frames

from .blocks import BLOCK_ROWS, KEY, disjoint_join, number_rows, top_rows, with_block, with_totals
from .series import threshold_runs, topk_span


# --- budgeted picks --------------------------------------------------------------------------------------------

def budget_sample(
    df: DataFrame, segments: DataFrame, budget: int = 8, gap: int = 2, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS
) -> DataFrame:
    """Greedy picks per segment (inclusive ends, not overlapping): first and last row, then by score with a minimum spacing.

    A segment may pick ``max(2, budget * its share of the selected length)`` rows, rounded half to even, so many
    short segments can exceed the budget. Every pick rules out at most ``2 * (gap - 1)`` others, so the best
    ``budget * (2 * gap - 1)`` interior rows of a segment always contain the greedy answer; only those are gathered.
    """
    length = F.col("end_idx") - F.col("start_idx") + 1
    spans = segments.select(*keys, "seg_no", "start_idx", "end_idx", length.alias("_len"))
    spans = with_totals(with_block(spans, "start_idx", size), keys, _total=("sum", F.col("_len"))).drop("blk")
    share = F.bround(budget * F.col("_len") / F.col("_total")).cast("int")
    spans = spans.select(*keys, "seg_no", "start_idx", "end_idx", F.greatest(F.lit(2), share).alias("_budget"))

    is_end = (F.col("idx") == F.col("start_idx")) | (F.col("idx") == F.col("end_idx"))
    rows = disjoint_join(df.select(*keys, "idx", "score"), spans, keys, size=size)
    rows = rows.withColumn("_inner", F.when(is_end, 0).otherwise(1)).filter("_inner = 0 or _budget > 2")
    merit = F.when(F.col("_inner") == 0, F.lit(float("inf"))).otherwise(F.nanvl("score", F.lit(float("-inf"))))
    enough = max(2, budget) * (2 * gap - 1) + 2
    rows = top_rows(rows.withColumn("_merit", merit), (*keys, "seg_no"), enough, "_merit")

    ordered = F.array_sort(F.collect_list(F.struct("_rn", "_inner", "idx", "score")))
    gathered = rows.groupBy(*keys, "seg_no").agg(ordered.alias("rows"), F.first("_budget").alias("_budget"))

    def take(picked: Column, row: Column) -> Column:
        apart = F.forall(picked, lambda p: F.abs(p["idx"] - row["idx"]) >= gap)
        fits = (row["_inner"] == 0) | ((F.size(picked) < F.col("_budget")) & apart)
        return F.when(fits, F.concat(picked, F.array(row))).otherwise(picked)

    picks = F.explode(F.aggregate("rows", F.slice("rows", 1, 0), take)).alias("p")
    return gathered.select(*keys, "seg_no", picks).select(*keys, "seg_no", "p.idx", "p.score")


def adaptive_segments(
    df: DataFrame, tau: float, budget: int = 8, gap: int = 2, size: int = BLOCK_ROWS
) -> DataFrame:
    """Picks under the first of four falling thresholds that fills half the budget; else from the top-score span.

    ``threshold`` is the accepted one, 0 for the fallback.
    """
    ladder = [tau, tau * 0.67, tau * 0.33, 0.05]
    keys = ("series_id", "step")
    steps = F.explode(F.array(*[F.lit(i) for i in range(len(ladder))]))
    rows = df.select("series_id", "idx", "score", steps.alias("step"))
    level = F.get(F.array(*[F.lit(t) for t in ladder]), F.col("step"))
    segments = threshold_runs(rows, level, keys, size)
    picks = budget_sample(rows, segments, budget, gap, keys, size)

    filled = picks.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(2, budget // 2))
    accepted = filled.groupBy("series_id").agg(F.min("step").alias("step"))
    level = F.round(F.get(F.array(*[F.lit(t) for t in ladder]), F.col("step")), 3)
    chosen = picks.join(accepted, list(keys)).withColumn("threshold", level).drop("step")

    span = topk_span(df, budget).join(accepted, "series_id", "left_anti").withColumn("seg_no", F.lit(0).cast("long"))
    fallback = budget_sample(df, span, budget, gap, KEY, size).withColumn("threshold", F.lit(0.0))
    return chosen.unionByName(fallback)


# --- snippet selections ----------------------------------------------------------------------------------------

def topk_snippet_frames(df: DataFrame, series: DataFrame, k: int = 5, pooled: int = 32) -> DataFrame:
    """The k best positions of each pooled series in time order, with their frame in the recording."""
    top = top_rows(df, KEY, k)
    top = top.join(series.select("series_id", "n_frames", "n_snip"), "series_id")
    frame = frames.topk_frame(F.col("idx"), F.col("n_frames"), F.col("n_snip"), pooled)
    return top.select("series_id", "idx", frame.alias("frame"), "score")


def top_n(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """Global first n rows; each task keeps n rows and only those are merged."""
    return df.orderBy(*order).limit(n)


def leaderboard(sweep: DataFrame, n: int = 20) -> DataFrame:
    """Best n sweep rows by accuracy, F1 and balanced accuracy; ties keep sweep order."""
    rest = [c for c in ("k", "threshold") if c in sweep.columns]
    return top_n(sweep, n, [F.desc("accuracy"), F.desc("f1"), F.desc("balanced_accuracy"), *rest])


# --- frame pools over an annotated window ----------------------------------------------------------------------
# rows: (series_id, idx, score, n_frames, n_snip), the snippets inside each window

def dedup_frames(df: DataFrame, order: Column | str = "idx") -> DataFrame:
    """One row per frame, the first in ``order``."""
    return df.groupBy("series_id", "frame").agg(F.min_by("score", order).alias("score"))


def _grid(expr: Callable[..., Column]) -> Column:
    return expr(F.col("idx"), F.col("n_frames"), F.col("n_snip"))


def every_snippet_mid(rows: DataFrame, **_) -> DataFrame:
    return dedup_frames(rows.withColumn("frame", _grid(frames.snippet_mid)))


def every_snippet_first(rows: DataFrame, **_) -> DataFrame:
    return dedup_frames(rows.withColumn("frame", _grid(frames.snippet_lo)))


def _band(rows: DataFrame, delta: int) -> DataFrame:
    band = F.sequence(_grid(frames.snippet_mid) - delta, _grid(frames.snippet_mid) + delta)
    inside = F.col("frame").between(_grid(frames.snippet_lo), _grid(frames.snippet_hi))
    return rows.withColumn("frame", F.explode(band)).filter(inside)


def mid_frame_band(rows: DataFrame, delta: int = 2, **_) -> DataFrame:
    """Middle frame of each snippet and ``delta`` frames on both sides, kept inside the snippet."""
    return dedup_frames(_band(rows, delta))


def human_span_smart(rows: DataFrame, budget: int = 8, gap: int = 2, size: int = BLOCK_ROWS, **_) -> DataFrame:
    """First, last and best spaced snippets of the whole window, one frame each."""
    window = rows.groupBy("series_id").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"),
        F.first("n_frames").alias("n_frames"), F.first("n_snip").alias("n_snip"),
    )
    picks = budget_sample(rows, window.withColumn("seg_no", F.lit(0)), budget, gap, size=size)
    picks = picks.join(window.select("series_id", "n_frames", "n_snip"), "series_id")
    return dedup_frames(picks.withColumn("frame", _grid(frames.snippet_mid)))


def top3_frame_band(rows: DataFrame, delta: int = 2, **_) -> DataFrame:
    """The three best snippets, each with a band around its middle frame."""
    return dedup_frames(_band(top_rows(rows, KEY, 3), delta), "_rn")


# fixed values: strategy names as they appear in manifests
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "every_snippet_mid": every_snippet_mid,
    "every_snippet_first": every_snippet_first,
    "every_snippet_mid_frame_band": mid_frame_band,
    "human_span_smart": human_span_smart,
    "top3_snippets_mid_frame_band": top3_frame_band,
}


def run_strategies(rows: DataFrame, names: Sequence[str] = tuple(STRATEGIES), **options) -> DataFrame:
    """Frames of each named strategy, with the strategy's name and position in the list."""
    unknown = [n for n in names if n not in STRATEGIES]
    if unknown:
        raise ValueError(f"unknown strategies {unknown}; choose from {list(STRATEGIES)}")
    parts = [
        STRATEGIES[n](rows, **options).withColumns({"strategy": F.lit(n), "strategy_no": F.lit(i)})
        for i, n in enumerate(names)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_strategies(df: DataFrame, names: Sequence[str] = tuple(STRATEGIES)) -> DataFrame:
    """``(series_id, strategy)`` pairs to keep: a strategy whose frames equal an earlier one's is dropped.

    Each frame is reduced to the set of strategies naming it, and each series to its distinct sets (at most
    2**strategies), so frame lists are compared exactly without being gathered.
    """
    sets = df.groupBy("series_id", "frame").agg(F.array_sort(F.collect_set("strategy_no")).alias("m"))
    sets = sets.groupBy("series_id").agg(F.collect_set("m").alias("m"))

    def member(i: int) -> Callable[[Column], Column]:
        return lambda m: F.array_contains(m, F.lit(i))

    def differ(i: int, j: int) -> Callable[[Column], Column]:
        return lambda m: member(i)(m) != member(j)(m)

    keep = []
    for i, name in enumerate(names):
        fresh = F.exists("m", member(i))
        for j in range(i):
            fresh = fresh & F.exists("m", differ(i, j))
        keep.append(F.when(fresh, F.lit(name)))
    kept = F.explode(F.array_compact(F.array(*keep))).alias("strategy")
    return sets.select("series_id", kept)


def dedup_strategies(df: DataFrame, names: Sequence[str] = tuple(STRATEGIES)) -> DataFrame:
    """Frames of the strategies that ``distinct_strategies`` keeps."""
    return df.join(distinct_strategies(df, names), ["series_id", "strategy"], "left_semi")


# --- seeded selections -----------------------------------------------------------------------------------------

def hash_order(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def hash_number(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, name: str = "pos"
) -> DataFrame:
    """Position (from 1) in the seeded order within ``keys``; 65,536 hash prefixes keep any key spread out."""
    hashed = df.withColumn("_h", hash_order(seed, *ids))
    return number_rows(hashed, keys, ["_h", *ids], hash_prefix("_h"), name, 1).drop("_h")


def hash_prefix(digest: str) -> Column:
    """The first four of the hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def hash_shuffle(df: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Seeded global order as a ``pos`` column, from 1."""
    return hash_number(df, (), ids, seed)


def balanced_sample(
    df: DataFrame, n_pos: int, n_neg: int, seed: int = 42, label: str = "label", id_col: str = "series_id"
) -> DataFrame:
    """n rows per class in the seeded order; the job fails when a class is too small."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    enough = (F.col("p") >= n_pos) & (F.col("n") >= n_neg)
    failed = F.assert_true(enough, F.lit(f"fewer than {n_pos} positive or {n_neg} negative rows"))
    # the one row of counts is there even for an empty input; it passes the check or fails the job, and is never returned
    checked = counts.filter(failed.isNotNull()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    wanted = F.when(F.col(label) == 1, n_pos).when(F.col(label) == 0, n_neg).otherwise(0)
    ranked = hash_number(df, [label], [id_col], seed, "_pos")
    return ranked.filter(F.col("_pos") <= wanted).select(*df.columns).unionByName(checked)


def stratified_sample(
    df: DataFrame, n: int, per_scene: int = 3, seed: int = 42, scene: str = "scene", id_col: str = "series_id"
) -> DataFrame:
    """At most ``per_scene`` rows of each scene, then the first n in a seeded order."""
    hashed = df.withColumn("_h", hash_order(seed, id_col))
    first = Window.partitionBy(scene).orderBy("_h", id_col)
    some = hashed.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= per_scene)
    return top_n(some, n, ["_h", id_col]).select(*df.columns)


def sample_negatives(
    videos: DataFrame, annotated: DataFrame, n: int = 30, min_frames: int = 50, seed: int = 42, id_col: str = "series_id"
) -> DataFrame:
    """Unannotated recordings with enough frames, the first n in a seeded order."""
    usable = videos.filter(F.col("n_frames") >= min_frames).join(annotated.select(id_col), id_col, "left_anti")
    return top_n(usable.withColumn("_h", hash_order(seed, id_col)), n, ["_h", id_col]).select(*videos.columns)


def spaced_positives(
    labels: DataFrame, neighbours: int = 3, picks: int = 2, extra_last: int = 8, limit: int = 50,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Evenly spaced positive frames that have ``neighbours`` frames on both sides.

    The last ``extra_last`` series (by id) get one more pick. The first ``limit`` picks are returned.
    """
    rows = with_totals(with_block(labels, "frame", size), KEY, _frames=("count", F.lit(1))).drop("blk")
    usable = rows.filter(
        (F.col("label") == 1) & (F.col("frame") >= neighbours) & (F.col("frame") < F.col("_frames") - neighbours)
    ).select("series_id", "frame")
    slot = F.expr(f"frame div {int(size)}")
    placed = number_rows(usable, KEY, ["frame"], slot, "_at")
    sizes = usable.groupBy("series_id").agg(F.count("*").alias("_m"))
    last = labels.groupBy("series_id").agg(F.lit(1).alias("_more")).orderBy(F.desc("series_id")).limit(extra_last)
    wanted = F.least(F.lit(picks) + F.coalesce("_more", F.lit(0)), F.col("_m")).cast("int")
    at = F.transform(
        F.sequence(F.lit(0), wanted - 1),
        lambda j: F.when(wanted == 1, F.lit(0)).otherwise(F.floor(j * (F.col("_m") - 1) / (wanted - 1))).cast("long"),
    )
    targets = sizes.join(last, "series_id", "left").select("series_id", F.explode(at).alias("_at"))
    chosen = placed.join(targets, ["series_id", "_at"]).select("series_id", "frame")
    return top_n(chosen, limit, ["series_id", "frame"])


def top_regions(
    values: DataFrame, percent: int = 75, at_most: int = 5, keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """Regions whose mean value reaches the given percentile of their frame, the best ``at_most``.

    Reaching an interpolated percentile is the same as reaching the value at the next higher rank, and that rank
    is either among the best ``at_most`` rows or below all of them, so no full ranking is needed.
    """
    regions = values.groupBy(*keys, "region").agg(F.avg("value").alias("region_score"))
    counts = regions.groupBy(*keys).agg(F.count("*").alias("_n"))
    best = Window.partitionBy(*keys).orderBy(F.desc("region_score"), "region")
    top = regions.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= at_most).join(counts, list(keys))
    cut_rank = F.expr(f"_n - ({int(percent)} * (_n - 1) + 99) div 100")
    cut = F.max(F.when(F.col("rank") == cut_rank, F.col("region_score"))).over(Window.partitionBy(*keys))
    top = top.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col("region_score") >= F.col("_cut")))
    return top.select(*keys, "region", "rank", "region_score")


# --- uniform frames --------------------------------------------------------------------------------------------

def uniform_frames(videos: DataFrame, k: int, mode: str = "trunc", k1: str = "first") -> DataFrame:
    """k frames per recording, one row each; mode is ``trunc`` or ``round``."""
    at = arrays.uniform_trunc(F.col("n_frames"), k) if mode == "trunc" else arrays.uniform_round(F.col("n_frames"), k, k1)
    return videos.select("series_id", F.posexplode(at).alias("pos", "frame"))
