"""Registered queries of the selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.functions import arrays, frames
from scorewise.operators import intervals as I
from scorewise.operators import sampling as P
from scorewise.operators import series as S

from scorewise.sources.shared import written

from . import fixtures as fx
from .registry import query
from .series_queries import RUNS, runs_sql

# --- SQL twins -------------------------------------------------------------------------------------------------


def picks_steps(rows: str, segments: str, keys: str = "series_id", budget: int = 8, gap: int = 2, tag: str = "") -> dict:
    """Greedy picks as a recursion over all interior rows of each segment, best first."""
    on = lambda a, b: " and ".join(f"{a}.{k}={b}.{k}" for k in [*keys.split(", "), "seg_no"])
    return {
        f"seg{tag}": f"""select *, greatest(2, cast(round_even({budget}*(end_idx-start_idx+1)/sum(end_idx-start_idx+1)
 over (partition by {keys}), 0) as bigint)) budget from ({segments})""",
        f"cand{tag}": f"""select g.*, r.idx, row_number() over (partition by {", ".join("g." + k for k in keys.split(", "))},
 g.seg_no order by r.score desc, r.idx) rn from seg{tag} g join {rows} r on {" and ".join(f"g.{k}=r.{k}" for k in keys.split(", "))}
 and r.idx > g.start_idx and r.idx < g.end_idx""",
        f"fold{tag}": f"""select {keys}, seg_no, cast(0 as bigint) rn, case when start_idx=end_idx then [start_idx]
 else [start_idx, end_idx] end picked from seg{tag} union all
 select {", ".join("f." + k for k in keys.split(", "))}, f.seg_no, c.rn, case when len(f.picked) < c.budget and
 len(list_filter(f.picked, lambda p: abs(p-c.idx) < {gap})) = 0 then list_append(f.picked, c.idx) else f.picked end
 from fold{tag} f join cand{tag} c on {on("f", "c")} and c.rn = f.rn+1""",
        f"picks{tag}": f"""select {", ".join("k." + k for k in keys.split(", "))}, k.seg_no, k.idx, r.score from (select {keys}, seg_no,
 unnest(arg_max(picked, rn)) idx from fold{tag} group by {keys}, seg_no) k join {rows} r on
 {" and ".join(f"k.{x}=r.{x}" for x in keys.split(", "))} and k.idx=r.idx""",
    }


GRID = """select *, greatest(lo, least(n_frames-1, floor((idx+1)*n_frames/n_snip)-1)) hi from (
 select s.*, v.n_frames, v.n_snip, floor(idx*n_frames/n_snip) lo from scores s join videos v using (series_id))"""
WIN = "select g.*, floor((lo+hi)/2) mid from grid g join annotations a using (series_id) where not (hi < start_frame or lo > end_frame)"
POOL = dict(grid=GRID, win=WIN)
_RANKED = "select *, row_number() over (partition by series_id order by score desc, idx) rn from {0}"
_FRAME = "series_id:i frame:i score:d"


def _first(rows: str, frame: str, order: str = "idx") -> str:
    return f"select series_id, {frame} frame, arg_min(score, {order}) score from {rows} group by 1, 2"


_BAND = "(select *, mid + unnest([-2,-1,0,1,2]) fr from {0})"
POOL_SQL = {
    "every_snippet_mid": _first("win", "mid"),
    "every_snippet_first": _first("win", "lo"),
    "every_snippet_mid_frame_band": _first(f"(select * from {_BAND.format('win')} where fr between lo and hi)", "fr"),
    "human_span_smart": _first("(select p.*, w.mid from picks_w p join win w using (series_id, idx))", "mid"),
    "top3_snippets_mid_frame_band": _first(
        f"(select * from {_BAND.format('(' + _RANKED.format('win') + ')')} where rn <= 3 and fr between lo and hi)", "fr", "rn"
    ),
}
SPAN_STEPS = picks_steps(
    "scores", "select series_id, 0 seg_no, min(idx) start_idx, max(idx) end_idx from win group by 1", tag="_w"
)
UNION_SQL = " union all ".join(
    f"select '{n}' strategy, {i} strategy_no, * from ({q})" for i, (n, q) in enumerate(POOL_SQL.items())
)


def window_rows(spark, sf):
    """Snippets inside the annotated windows, the input of every pool."""
    windows = I.annotated_windows(fx.annotations(spark, sf), fx.videos(spark, sf))
    return written(I.overlap_join(fx.scores(spark, sf), windows), "windows")


def uniform_videos(spark, sf):
    return fx.videos(spark, sf).select("series_id", (F.col("n_snip") % 60).alias("n_frames"))


# --- budgeted picks --------------------------------------------------------------------------------------------

@query("budget_sample", "series_id:i seg_no:i idx:i score:d", "select * from picks", **picks_steps("scores", RUNS))
def _(spark, sf):
    scores = fx.scores(spark, sf)
    return P.budget_sample(scores, S.threshold_runs(scores, 0.5))


@query(
    "budget_sample_hysteresis", "series_id:i seg_no:i idx:i score:d", "select * from picks",
    **picks_steps("scores", runs_sql("scores", "score > 0.6", "score < 0.05"), budget=12, gap=3),
)
def _(spark, sf):
    scores = fx.scores(spark, sf)
    long = S.hysteresis_segments(scores, 0.6, 0.05, 1).withColumn("end_idx", F.col("end_idx") - 1)
    return P.budget_sample(scores, long, 12, 3)


_LADDER = "[0.85, 0.85*0.67, 0.85*0.33, 0.05]"
_STEPPED = f"select s.*, t.step, ({_LADDER})[t.step+1] tau from scores s, (select unnest([0,1,2,3]) step) t"


@query(
    "adaptive_segments", "series_id:i threshold:d seg_no:i idx:i score:d",
    f"""select p.series_id, round(({_LADDER})[p.step+1], 3) threshold, p.seg_no, p.idx, p.score from picks_a p join accepted
 using (series_id, step) union all select series_id, 0, seg_no, idx, score from picks_f""",
    stepped=_STEPPED,
    **picks_steps("stepped", runs_sql("stepped", "score > tau", "score <= tau", "series_id, step"), "series_id, step", tag="_a"),
    accepted="""select series_id, min(step) step from (select series_id, step from picks_a group by all
 having count(*) >= 4) group by 1""",
    span="select series_id, 0 seg_no, min(idx) start_idx, max(idx) end_idx from (" + _RANKED.format("scores")
    + ") where rn <= 8 and series_id not in (select series_id from accepted) group by 1",
    **picks_steps("scores", "select * from span", tag="_f"),
)
def _(spark, sf):
    return P.adaptive_segments(fx.scores(spark, sf), 0.85)


# --- snippet and frame arithmetic ------------------------------------------------------------------------------

@query(
    "snippet_mid_frame", "series_id:i idx:i frame:i",
    """select s.series_id, idx, least(cast(floor(idx*(n_frames/n_snip)) as bigint) + cast(floor((n_frames/n_snip)/2) as bigint),
 n_frames-1) frame from scores s join videos v using (series_id)""",
)
def _(spark, sf):
    rows = fx.scores(spark, sf).join(fx.videos(spark, sf), "series_id")
    frame = frames.snippet_mid_frame(F.col("idx"), F.col("n_frames"), F.col("n_snip"))
    return rows.select("series_id", "idx", frame.alias("frame"))


@query(
    "uniform_trunc", "series_id:i pos:i frame:i",
    """select series_id, unnest(range(len(f))) pos, unnest(f) frame from (select series_id, case when n <= 5 then range(n)
 else list_transform(range(5), lambda i: (i*(n-1))//4) end f from (select series_id, n_snip%60 n from videos))""",
)
def _(spark, sf):
    return P.uniform_frames(uniform_videos(spark, sf), 5)


@query(
    "uniform_interior", "series_id:i seg_no:i frame:i",
    """select series_id, seg_no, unnest(case when n <= 3 then list_transform(range(n), lambda i: s+i)
 else list_transform(range(3), lambda i: s + cast(floor(n/4.0*(i+1)) as bigint)) end) frame from (
 select series_id, seg_no, start_idx s, end_idx-start_idx+1 n from (""" + RUNS + "))",
)
def _(spark, sf):
    runs = S.threshold_runs(fx.scores(spark, sf), 0.5)
    at = arrays.uniform_interior(F.col("start_idx"), F.col("end_idx") + 1, 3)
    return runs.select("series_id", "seg_no", F.explode(at).alias("frame"))


@query(
    "uniform_round", "series_id:i frame:i",
    """select distinct series_id, unnest(case when n <= 5 then range(n)
 else list_transform(range(5), lambda i: cast(round_even(i*(n-1)/4.0, 0) as bigint)) end) frame
 from (select series_id, n_snip%60 n from videos)""",
)
def _(spark, sf):
    return P.uniform_frames(uniform_videos(spark, sf), 5, "round")


@query(
    "uniform_round_middle", "series_id:i frame:i",
    "select series_id, n//2 frame from (select series_id, n_snip%60 n from videos) where n > 0",
)
def _(spark, sf):
    return P.uniform_frames(uniform_videos(spark, sf), 1, "round", "middle")


@query(
    "topk_snippet_frames", "series_id:i idx:i frame:i score:d",
    """select s.series_id, idx, least(cast(floor(idx*(n_snip/32.0)) as bigint)*16+8, n_frames-1) frame, score
 from (""" + _RANKED.format("scores") + ") s join videos v using (series_id) where rn <= 5",
)
def _(spark, sf):
    return P.topk_snippet_frames(fx.scores(spark, sf), fx.videos(spark, sf))


# --- frame pools -----------------------------------------------------------------------------------------------

def _pool(name: str, strategy: str) -> None:
    steps = {**POOL, **(SPAN_STEPS if strategy == "human_span_smart" else {})}

    @query(f"pool_{name}", _FRAME, POOL_SQL[strategy], **steps)
    def _(spark, sf):
        return P.STRATEGIES[strategy](window_rows(spark, sf))


for _name, _strategy in zip(("snippet_mid", "snippet_first", "mid_band", "span_smart", "top3_band"), POOL_SQL):
    _pool(_name, _strategy)


@query(
    "dedup_frames", _FRAME,
    "select series_id, idx//3 frame, arg_min(score, idx) score from scores group by 1, 2",
)
def _(spark, sf):
    return P.dedup_frames(fx.scores(spark, sf).withColumn("frame", F.expr("idx div 3")))


@query("run_strategies", "strategy:s series_id:i frame:i score:d", UNION_SQL, **POOL, **SPAN_STEPS)
def _(spark, sf):
    return P.run_strategies(window_rows(spark, sf))


@query(
    "dedup_strategies", "series_id:i strategy:s",
    """select series_id, strategy from (select *, row_number() over (partition by series_id, f order by strategy_no) rn
 from (select series_id, strategy, strategy_no, list(frame order by frame) f from pooled group by all)) where rn = 1""",
    **POOL, **SPAN_STEPS, pooled=UNION_SQL,
)
def _(spark, sf):
    return P.distinct_strategies(P.run_strategies(window_rows(spark, sf)))


# --- seeded selections -----------------------------------------------------------------------------------------

_HASH = "md5(concat_ws(':', '42', series_id))"


@query(
    "balanced_sample", "series_id:i label:i",
    f"""select series_id, label from (select *, row_number() over (partition by label order by {_HASH}) rn from videos)
 where rn <= case when label=1 then 3 else 10 end""",
)
def _(spark, sf):
    return P.balanced_sample(fx.videos(spark, sf), 3, 10)


@query(
    "stratified_sample", "series_id:i scene:i",
    f"""select series_id, scene from (select *, row_number() over (partition by scene order by {_HASH}) rn from videos)
 where rn <= 3 order by {_HASH} limit 20""",
)
def _(spark, sf):
    return P.stratified_sample(fx.videos(spark, sf), 20)


@query(
    "sample_negatives", "series_id:i n_frames:i",
    f"""select series_id, n_frames from videos where n_frames >= 900 and series_id not in (select series_id from annotations)
 order by {_HASH} limit 30""",
)
def _(spark, sf):
    return P.sample_negatives(fx.videos(spark, sf), fx.annotations(spark, sf), 30, 900)


@query(
    "hash_shuffle", "video_id:i pos:i",
    """select video_id, row_number() over (order by md5(concat_ws(':', '42', video_id)), video_id) pos from judged""",
)
def _(spark, sf):
    return P.hash_shuffle(fx.judged(spark, sf).select("video_id"), ["video_id"])


@query(
    "spaced_positives", "series_id:i frame:i",
    """select series_id, frame from (select p.*, m, least(m, 2 + case when series_id in (select series_id from videos
 order by series_id desc limit 8) then 1 else 0 end) k from (select *, row_number() over (partition by series_id order by frame)-1 a,
 count(*) over (partition by series_id) m from frame_labels join videos v using (series_id) where frame_labels.label=1
 and frame >= 3 and frame < n_snip-3) p) where list_contains(list_transform(range(k), lambda j: case when k=1 then 0
 else (j*(m-1))//(k-1) end), a) order by series_id, frame limit 50""",
)
def _(spark, sf):
    return P.spaced_positives(fx.frame_labels(spark, sf))


@query(
    "top_regions", "frame:i region:i rank:i region_score:d",
    """select frame, region, rank, region_score from (select *, row_number() over (partition by frame order by region_score desc,
 region) rank, quantile_cont(region_score, 0.75) over (partition by frame) cut from (select l_suppkey frame,
 l_partkey%17 region, avg(l_extendedprice/(l_extendedprice+50000.0)) region_score from lineitem group by 1, 2))
 where rank <= 5 and region_score >= cut""",
)
def _(spark, sf):
    price = F.col("l_extendedprice")
    values = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 17).alias("region"), (price / (price + 50000.0)).alias("value")
    )
    return P.top_regions(values)


@query(
    "top_n", "series_id:i idx:i score:d",
    "select * from scores order by score desc, series_id, idx limit 20",
)
def _(spark, sf):
    return P.top_n(fx.scores(spark, sf), 20, [F.desc("score"), "series_id", "idx"])


# --- intervals -------------------------------------------------------------------------------------------------

_SHIFTED = """select series_id, start_frame + (series_id%4)*400 start_frame, end_frame + (series_id%4)*400 end_frame
 from annotations"""


def shifted(spark, sf):
    """Annotations moved right, some beyond the last frame."""
    move = (F.col("series_id") % 4) * 400
    ann = fx.annotations(spark, sf)
    return ann.select("series_id", (F.col("start_frame") + move).alias("start_frame"), (F.col("end_frame") + move).alias("end_frame"))


@query("overlap_join", "series_id:i idx:i score:d", "select series_id, idx, score from win", **POOL)
def _(spark, sf):
    scores = fx.scores(spark, sf)
    return I.overlap_join(scores, I.overlap_windows(fx.annotations(spark, sf), fx.videos(spark, sf)))


@query(
    "nearest_snippet", "series_id:i idx:i",
    """select series_id, arg_min(idx, d*1000000+idx) idx from (select g.series_id, g.idx, case when c < lo then lo-c when c > hi
 then c-hi else 0 end d from grid g join (select *, floor((start_frame+end_frame)/2) c from moved) using (series_id)) group by 1""",
    grid=GRID, moved=_SHIFTED,
)
def _(spark, sf):
    return I.nearest_snippet(shifted(spark, sf), fx.videos(spark, sf))


@query(
    "annotated_windows", "series_id:i start_idx:i end_idx:i",
    """select series_id, coalesce(min(idx) filter (hit), arg_min(idx, d*1000000+idx)) start_idx,
 coalesce(max(idx) filter (hit), arg_min(idx, d*1000000+idx)) end_idx from (select g.series_id, g.idx,
 not (hi < start_frame or lo > end_frame) hit, case when c < lo then lo-c when c > hi then c-hi else 0 end d
 from grid g join (select *, floor((start_frame+end_frame)/2) c from moved) using (series_id)) group by 1""",
    grid=GRID, moved=_SHIFTED,
)
def _(spark, sf):
    return I.annotated_windows(shifted(spark, sf), fx.videos(spark, sf))


@query(
    "span_to_snippets", "series_id:i snip_lo:i snip_hi:i",
    """select series_id, greatest(0, least(floor(start_frame/(n_frames/n_snip)), n_snip-1)) snip_lo,
 greatest(0, least(floor(end_frame/(n_frames/n_snip)), n_snip-1)) snip_hi from moved join videos using (series_id)""",
    moved=_SHIFTED,
)
def _(spark, sf):
    return I.span_to_snippets(shifted(spark, sf), fx.videos(spark, sf))


@query(
    "label_span", "series_id:i start_frame:i end_frame:i",
    """select series_id, min(frame) filter (label=1 and series_id%7<>0) start_frame,
 max(frame) filter (label=1 and series_id%7<>0) end_frame from frame_labels group by 1""",
)
def _(spark, sf):
    shown = F.when(F.col("series_id") % 7 != 0, F.col("label")).otherwise(0)
    return I.label_span(fx.frame_labels(spark, sf).withColumn("label", shown))


@query(
    "intervals_to_labels", "series_id:i frame:i label:i",
    """select f.series_id, f.frame, max(case when f.frame between s.start_frame and s.end_frame then 1 else 0 end) as label
 from (select series_id, unnest(range(n_frames)) frame from videos) f left join spans s on s.series_id = f.series_id group by 1, 2""",
    spans="""select series_id, start_frame, end_frame from annotations union all
 select series_id, 40, 200 from annotations where series_id%2=0""",
)
def _(spark, sf):
    ann = fx.annotations(spark, sf)
    second = ann.filter("series_id % 2 = 0").select("series_id", F.lit(40).alias("start_frame"), F.lit(200).alias("end_frame"))
    return I.intervals_to_labels(fx.videos(spark, sf), ann.unionByName(second))


@query(
    "align_labels_zero", "series_id:i frame:i label:i",
    """select t.series_id, t.frame, coalesce(l.label, 0) as label from (select series_id,
 unnest(range(greatest(1, count(*)//16)*16)) frame from short group by 1) t left join short l using (series_id, frame)""",
    short="select * from frame_labels union all select series_id+1000000000 series_id, frame, label from frame_labels where frame < 10",
)
def _(spark, sf):
    """Whole recordings, and beside them the beginnings of all as recordings shorter than a clip."""
    whole = fx.frame_labels(spark, sf)
    short = whole.filter("frame < 10").withColumn("series_id", F.col("series_id") + 1_000_000_000)
    return I.align_labels(whole.unionByName(short))


@query(
    "align_labels_last", "series_id:i frame:i label:i",
    """select t.series_id, t.frame, coalesce(l.label, e.last) as label from (select series_id, unnest(range(n_snip*16)) frame
 from videos) t left join frame_labels l using (series_id, frame)
 join (select series_id, arg_max(label, frame) as last from frame_labels group by 1) e using (series_id)""",
)
def _(spark, sf):
    return I.align_labels(fx.frame_labels(spark, sf), fx.videos(spark, sf), "last")


@query(
    "expand_snippets", "series_id:i frame:i score:d",
    "select series_id, idx*16 + unnest(range(16)) frame, score from scores",
)
def _(spark, sf):
    return I.expand_snippets(fx.scores(spark, sf))


@query(
    "temporal_iou",
    "series_id:i gt_start:i gt_end:i detected_start:i detected_end:i num_segments:i temporal_iou:d",
    """select v.series_id, a.start_frame gt_start, a.end_frame gt_end, d.s detected_start, d.e detected_end,
 coalesce(n, 0) num_segments, case when a.start_frame is not null and d.s is not null then
 greatest(least(a.end_frame, d.e) - greatest(a.start_frame, d.s), 0) / (a.end_frame-a.start_frame + d.e-d.s -
 greatest(least(a.end_frame, d.e) - greatest(a.start_frame, d.s), 0)) else 0 end temporal_iou
 from videos v left join annotations a using (series_id) left join (select series_id, arg_min(start_idx*16, seg_no) s,
 arg_min(end_idx*16, seg_no) e, count(*) n from runs where end_idx > start_idx group by 1) d using (series_id)""",
    runs=runs_sql("scores", "score > 0.6", "score < 0.05"),
)
def _(spark, sf):
    segments = S.hysteresis_segments(fx.scores(spark, sf), 0.6, 0.05, 2).select(
        "series_id", "seg_no", (F.col("start_idx") * 16).alias("start_frame"), ((F.col("end_idx") - 1) * 16).alias("end_frame")
    )
    return I.temporal_iou(fx.annotations(spark, sf), segments, fx.videos(spark, sf))


@query(
    "frame_score", "series_id:i frame:i idx:i score:d",
    """select f.series_id, f.frame, f.idx, s.score from (select series_id, frame, least(n_snip-1,
 cast(floor(frame/greatest(n_frames,1)*n_snip) as bigint)) idx from (select *, unnest(list_distinct(list_transform(range(5),
 lambda i: cast(round_even(i*(n_frames-1)/4.0, 0) as bigint)))) frame from videos)) f join scores s using (series_id, idx)""",
)
def _(spark, sf):
    videos = fx.videos(spark, sf)
    at = F.explode(arrays.uniform_round(F.col("n_frames"), 5)).alias("frame")
    return I.frame_score(videos.select("series_id", "n_frames", "n_snip", at), fx.scores(spark, sf))
