"""Registered queries of the score-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.operators import series as S

from . import fixtures as fx
from .registry import query


# --- SQL twins shared by several queries -----------------------------------------------------------------------

def runs_sql(source: str, enter: str, leave: str, keys: str = "series_id") -> str:
    """Maximal runs (inclusive ends) of the state set by ``enter`` and cleared by ``leave``."""
    return f"""select {keys}, row_number() over (partition by {keys} order by min(idx))-1 seg_no,
 min(idx) start_idx, max(idx) end_idx from (
 select {keys}, idx, idx - row_number() over (partition by {keys} order by idx) grp from (
 select {keys}, idx, last_value(ev ignore nulls) over (partition by {keys} order by idx
  rows between unbounded preceding and current row) st from (
 select *, case when {enter} then 1 when {leave} then 0 end ev from {source})) where st = 1) group by {keys}, grp"""


RUNS = runs_sql("scores", "score > 0.5", "score <= 0.5")
HYSTERESIS = (
    "select series_id, row_number() over (partition by series_id order by start_idx)-1 seg_no, start_idx,"
    " end_idx+1 end_idx from (" + runs_sql("scores", "score > 0.5", "score < 0.3") + ") where end_idx+1-start_idx >= 3"
)
SUMMARY = """select g.series_id, g.seg_no, g.start_idx, g.end_idx, count(*) length, avg(score) mean_score,
 max(score) max_score from hyst g join scores s on s.series_id=g.series_id and s.idx >= g.start_idx and s.idx < g.end_idx
 group by all"""


def hysteresis(spark, sf):
    return S.hysteresis_segments(fx.scores(spark, sf), 0.5, 0.3, 3)


# --- smoothing and scaling -------------------------------------------------------------------------------------

_EDGED = """select series_id, idx, case when idx%11=3 then null when idx%40=7 and series_id%6=0 then 'nan'::double else score end score
 from scores where idx%9<>4"""


def edged(spark, sf):
    """Scores with nulls, NaN and missing positions."""
    score = F.when(F.col("idx") % 11 == 3, None).when((F.col("idx") % 40 == 7) & (F.col("series_id") % 6 == 0), float("nan")).otherwise(F.col("score"))
    return fx.scores(spark, sf).filter("idx % 9 <> 4").withColumn("score", score)


def _smooth_edged(name: str, range_: int, sigma: int) -> None:
    half = (range_ - 1) // 2
    @query(
        name, "series_id:i idx:i score:d",
        f"""select a.series_id, a.idx, sum(coalesce(b.score, 0)*exp(-0.5*pow((b.idx-a.idx+1)/{sigma}.0, 2))/({sigma}.0*sqrt(2*pi()))) score
 from edged a join edged b on a.series_id=b.series_id and b.idx-a.idx between -{half} and {half} group by all""",
        edged=_EDGED,
    )
    def _(spark, sf):
        return S.gaussian_smooth(edged(spark, sf), range_, sigma)


_smooth_edged("gaussian_smooth_gaps_narrow", 38, 11)
_smooth_edged("gaussian_smooth_gaps_wide", 66, 11)


@query(
    "topk_mean_nan_large_k", "series_id:i k:i topk_mean:d",
    """select series_id, k, case when count(*) filter (isnan(score)) > 0 then 'nan'::double else avg(score) end topk_mean
 from edged, (select unnest([1000, 1001]) k) group by 1, 2""",
    edged=_EDGED,
)
def _(spark, sf):
    rows = edged(spark, sf)
    each = [S.topk_mean(rows, k).withColumn("k", F.lit(k)) for k in (1000, 1001)]
    return each[0].unionByName(each[1])


@query(
    "gaussian_smooth", "series_id:i idx:i score:d",
    """select a.series_id, a.idx, sum(b.score*exp(-0.5*pow((b.idx-a.idx+1)/11.0, 2))/(11.0*sqrt(2*pi()))) score
 from scores a join scores b on a.series_id=b.series_id and b.idx-a.idx between -18 and 18 group by all""",
)
def _(spark, sf):
    return S.gaussian_smooth(fx.scores(spark, sf), 38, 11)


@query(
    "gaussian_smooth_wide", "series_id:i idx:i score:d",
    """select a.series_id, a.idx, sum(b.score*exp(-0.5*pow((b.idx-a.idx+1)/282.0, 2))/(282.0*sqrt(2*pi()))) score
 from scores a join scores b on a.series_id=b.series_id and b.idx-a.idx between -449 and 449 group by all""",
)
def _(spark, sf):
    return S.gaussian_smooth(fx.scores(spark, sf), 900, 282)


_MM = {
    "keep": "case when hi-lo < 1e-8 then score else (score-lo)/(hi-lo) end",
    "zero": "case when hi=lo then 0.0 else (score-lo)/(hi-lo) end",
    "eps": "(score-lo)/(hi-lo+1e-8)",
    "relu": "greatest(least((score-greatest(lo,0))/(case when greatest(hi,0)-greatest(lo,0) <= 0 then 1"
    " else greatest(hi,0)-greatest(lo,0) end),1),0)",
}


def _minmax(mode: str) -> None:
    @query(
        f"minmax_{mode}", "series_id:i idx:i score:d",
        f"""select series_id, idx, {_MM[mode]} score from (select *, min(score) over (partition by series_id) lo,
 max(score) over (partition by series_id) hi from (select series_id, idx, score - 0.3 score from scores))""",
    )
    def _(spark, sf):
        shifted = fx.scores(spark, sf).withColumn("score", F.col("score") - 0.3)
        return S.minmax(shifted, mode)


for _mode in _MM:
    _minmax(_mode)


# --- segments --------------------------------------------------------------------------------------------------

@query("threshold_runs", "series_id:i seg_no:i start_idx:i end_idx:i", RUNS)
def _(spark, sf):
    return S.threshold_runs(fx.scores(spark, sf), 0.5)


@query(
    "threshold_runs_nan", "series_id:i seg_no:i start_idx:i end_idx:i",
    runs_sql("(select series_id, idx, case when (series_id+idx)%7=0 then null else score end score from scores)",
             "score > 0.5", "score <= 0.5"),
)
def _(spark, sf):
    """Every seventh score is NaN, which keeps the current state."""
    nan = F.when((F.col("series_id") + F.col("idx")) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("score"))
    return S.threshold_runs(fx.scores(spark, sf).withColumn("score", nan), 0.5)


@query("hysteresis_segments", "series_id:i seg_no:i start_idx:i end_idx:i", HYSTERESIS)
def _(spark, sf):
    return hysteresis(spark, sf)


@query(
    "segment_summary", "series_id:i seg_no:i start_idx:i end_idx:i length:i mean_score:d max_score:d", SUMMARY,
    hyst=HYSTERESIS,
)
def _(spark, sf):
    scores = fx.scores(spark, sf)
    return S.segment_summary(scores, S.hysteresis_segments(scores, 0.5, 0.3, 3), "exclusive")


@query(
    "segment_mean_max", "series_id:i segment_mean_max:d",
    """select v.series_id, coalesce(max(mean_score), 0) segment_mean_max from videos v
 left join segs g on g.series_id=v.series_id group by all""",
    hyst=HYSTERESIS, segs=SUMMARY,
)
def _(spark, sf):
    scores = fx.scores(spark, sf)
    segments = S.segment_summary(scores, S.hysteresis_segments(scores, 0.5, 0.3, 3), "exclusive")
    return S.segment_mean_max(fx.videos(spark, sf).select("series_id"), segments)


@query(
    "first_segment", "series_id:i seg_no:i start_idx:i end_idx:i",
    "select * from (" + HYSTERESIS + ") where seg_no = 0",
)
def _(spark, sf):
    return S.first_segment(hysteresis(spark, sf))


@query(
    "flagged_segments", "series_id:i gate_score:d seg_no:i start_idx:i end_idx:i length:i mean_score:d max_score:d",
    """select t.series_id, gate_score, g.seg_no, g.start_idx, g.end_idx, count(*) length, avg(score) mean_score,
 max(score) max_score from gates t join runs g on g.series_id=t.series_id join scores s on s.series_id=g.series_id
 and s.idx between g.start_idx and g.end_idx where gate_score > 0.7 group by all""",
    runs=RUNS,
    gates="""select series_id, avg(score) gate_score from (select *, row_number() over (partition by series_id
 order by score desc, idx) rn from scores) where rn <= 8 group by series_id""",
)
def flagged_segments(spark, sf):
    """Which series are anomalous, where, and how strongly."""
    scores = fx.scores(spark, sf)
    gated = S.gate(S.topk_mean(scores, 8).withColumnRenamed("topk_mean", "gate_score"), 0.7).filter("flagged")
    summary = S.segment_summary(scores, S.threshold_runs(scores, 0.5))
    return summary.join(gated.drop("flagged"), "series_id")


# --- gates and decisions ---------------------------------------------------------------------------------------

_TOP = """select series_id, avg(score) topk_mean from (select *, row_number() over (partition by series_id
 order by score desc, idx) rn from scores) where rn <= {k} group by series_id"""


@query("topk_mean", "series_id:i topk_mean:d", _TOP.format(k=8))
def _(spark, sf):
    return S.topk_mean(fx.scores(spark, sf), 8)


@query("series_mean", "series_id:i full_mean:d", "select series_id, avg(score) full_mean from scores group by 1")
def _(spark, sf):
    return S.series_mean(fx.scores(spark, sf))


@query(
    "gate", "series_id:i gate_score:d flagged:b",
    "select series_id, topk_mean gate_score, topk_mean > 0.75 flagged from (" + _TOP.format(k=3) + ")",
)
def _(spark, sf):
    return S.gate(S.topk_mean(fx.scores(spark, sf), 3).withColumnRenamed("topk_mean", "gate_score"), 0.75)


@query(
    "decide", "series_id:i video_score:d prediction:i",
    "select series_id, avg(score) video_score, case when avg(score) >= 0.4 then 1 else 0 end prediction from scores"
    " group by 1",
)
def _(spark, sf):
    return S.decide(S.series_mean(fx.scores(spark, sf)).withColumnRenamed("full_mean", "video_score"), 0.4)


@query(
    "max_gate", "series_id:i max_score:d detected:b explanation:s",
    """select series_id, max(score) max_score, max(score) >= 0.8 detected,
 case when max(score) < 0.8 then 'Normal video, no anomaly detected.' end explanation from scores group by 1""",
)
def _(spark, sf):
    return S.max_gate(fx.scores(spark, sf), 0.8, "Normal video, no anomaly detected.")


@query(
    "topk_span", "series_id:i start_idx:i end_idx:i",
    """select series_id, min(idx) start_idx, max(idx) end_idx from (select *, row_number() over (partition by series_id
 order by score desc, idx) rn from scores) where rn <= 8 group by 1""",
)
def _(spark, sf):
    return S.topk_span(fx.scores(spark, sf), 8)


# --- summaries -------------------------------------------------------------------------------------------------

@query(
    "series_summary", "series_id:i n:i mean_score:d std_score:d max_score:d argmax_1based:i frac_above:d",
    """select series_id, count(*) n, avg(score) mean_score, stddev_pop(score) std_score, max(score) max_score,
 1 + (select min(idx) from scores b where b.series_id=a.series_id and b.score=max(a.score)) argmax_1based,
 avg(case when score > 0.5 then 1.0 else 0.0 end) frac_above from scores a group by series_id""",
)
def _(spark, sf):
    return S.series_summary(fx.scores(spark, sf), 0.5)


@query(
    "series_roughness", "series_id:i roughness:d l2_size:d",
    """select series_id, coalesce(sum(pow(nxt-score,2)),0) roughness, sqrt(sum(score*score)) l2_size from (
 select *, lead(score) over (partition by series_id order by idx) nxt from scores) group by 1""",
)
def _(spark, sf):
    return S.series_roughness(fx.scores(spark, sf))


@query(
    "position_profile", "idx:i mean_score:d std_score:d",
    """select idx, avg(score) mean_score, stddev_pop(score) std_score from listed
 where (select count(distinct n) from (select count(*) n from features group by series_id)) = 1 group by idx""",
    listed="""select series_id, idx*64 + dim idx, score from (select series_id, idx, unnest(range(len(vec))) dim, unnest(vec)::double score
 from features)""",
)
def _(spark, sf):
    """Every dimension of every position of the recordings."""
    rows = fx.features(spark, sf).select("series_id", "idx", F.posexplode("vec").alias("dim", "score"))
    return S.position_profile(rows.select("series_id", (F.col("idx") * 64 + F.col("dim")).alias("idx"), F.col("score").cast("double").alias("score")))


@query(
    "score_histogram", "label:i bin:i n:i",
    """select label, cast(least(floor((score-lo)/(hi-lo)*40), 39) as bigint) bin, count(*) n from (select *,
 min(score) over (partition by label) lo, max(score) over (partition by label) hi from numbered) group by 1, 2""",
)
def _(spark, sf):
    return S.score_histogram(fx.labelled_scores(spark, sf).select("label", "score"))


# --- neighbourhood windows -------------------------------------------------------------------------------------

@query(
    "centered_absdiff_self", "series_id:i idx:i absdiff:d",
    """select series_id, idx, abs(coalesce(lag(score,3) over w, score) - coalesce(lead(score,3) over w, score)) absdiff
 from scores window w as (partition by series_id order by idx)""",
)
def _(spark, sf):
    return S.centered_absdiff(fx.scores(spark, sf), 3)


@query(
    "centered_absdiff_clamp", "series_id:i idx:i absdiff:d",
    """select series_id, idx, abs(coalesce(lag(score,3) over w, first_value(score) over w)
 - coalesce(lead(score,3) over w, last_value(score) over (partition by series_id order by idx rows between unbounded
 preceding and unbounded following))) absdiff from scores window w as (partition by series_id order by idx)""",
)
def _(spark, sf):
    return S.centered_absdiff(fx.scores(spark, sf), 3, "clamp")


@query(
    "rolling_meter", "series_id:i idx:i median:d mean:d max:d value:d global_mean:d",
    """select series_id, idx, list_sort(list(score) over w)[(len(list(score) over w)+1)//2] median,
 avg(score) over w mean, max(score) over w as max, score as value, avg(score) over (partition by series_id order by idx
 rows between unbounded preceding and current row) global_mean from scores
 window w as (partition by series_id order by idx rows between 19 preceding and current row)""",
)
def _(spark, sf):
    return S.rolling_meter(fx.scores(spark, sf))


@query(
    "running_best", "series_id:i idx:i score:d is_best:b",
    """select series_id, idx, score, score > coalesce(max(score) over (partition by series_id order by idx rows between
 unbounded preceding and 1 preceding), -1) is_best from bench where idx > 200 and idx%5=0""",
)
def _(spark, sf):
    return S.running_best(fx.bench(spark, sf))


# --- frames ----------------------------------------------------------------------------------------------------

@query(
    "clip_windows", "series_id:i clip:i start_frame:i end_frame:i n_pad:i",
    """select series_id, clip, clip*16 start_frame, least(clip*16+16, n) end_frame, clip*16+16-least(clip*16+16, n) n_pad
 from (select series_id, n, unnest(range(greatest(1, n//16))) clip from (
 select user_id series_id, case when user_id%9=0 then 5+user_id%11 else count(*) end n from events group by user_id))""",
)
def _(spark, sf):
    short = F.when(F.col("series_id") % 9 == 0, 5 + F.col("series_id") % 11).otherwise(F.col("n_snip"))
    return S.clip_windows(fx.videos(spark, sf).select("series_id", short.alias("n_frames")))


@query(
    "take_while", "series_id:i track_no:i idx:i size:d",
    """select t.series_id, t.track_no, f.idx, f.score*10000 size from tracks t join scores f on f.series_id=t.series_id
 and f.idx >= t.start_idx and f.idx < t.end_idx where f.idx < coalesce((select min(g.idx) from scores g
 where g.series_id=t.series_id and g.idx >= t.start_idx and g.idx < t.end_idx and g.score*10000 < 800), 1000000000)""",
    tracks="""select series_id, unnest([0,1,2]) track_no, unnest([0,5,20]) start_idx, unnest([10,30,1000]) end_idx
 from videos""",
)
def _(spark, sf):
    frames = fx.scores(spark, sf).select("series_id", "idx", (F.col("score") * 10000).alias("size"))
    spans = F.expr("inline(array(struct(0, 0, 10), struct(1, 5, 30), struct(2, 20, 1000))) as (track_no, start_idx, end_idx)")
    tracks = fx.videos(spark, sf).select("series_id", spans)
    return S.take_while(frames, tracks)
