"""Registered queries of detector evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.operators import metrics as M
from scorewise.operators import sampling as P
from scorewise.operators import series as S

from . import fixtures as fx
from .registry import query
from .series_queries import HYSTERESIS, SUMMARY

_RATES = "accuracy:d precision:d recall:d f1:d balanced_accuracy:d"
_COUNTS = "tp:i tn:i fp:i fn:i"


def rates_sql(source: str, keep: str = "") -> str:
    """Add the rates to rows with tp, tn, fp, fn."""
    return f"""select {keep} tp, tn, fp, fn, case when tp+tn+fp+fn=0 then 0 else (tp+tn)/(tp+tn+fp+fn) end accuracy,
 precision, recall, case when precision+recall=0 then 0 else 2.0*precision*recall/(precision+recall) end f1,
 0.5*(recall + case when tn+fp=0 then 0 else tn/(tn+fp) end) balanced_accuracy from (select *,
 case when tp+fp=0 then 0 else tp/(tp+fp) end as precision, case when tp+fn=0 then 0 else tp/(tp+fn) end recall from ({source}))"""


def sweep_sql(source: str, steps: int, by: str = "", lo: str = "min(score)", hi: str = "max(score)", op: str = ">=") -> str:
    """Compare every row with every threshold."""
    keys = f"{by}, " if by else ""
    on = f"and b.{by}=r.{by}" if by else ""
    return rates_sql(
        f"""select {keys} step, threshold, count(*) filter (hit and label=1) tp, count(*) filter (not hit and label=0) tn,
 count(*) filter (hit and label=0) fp, count(*) filter (not hit and label=1) fn from (select b.*, r.label,
 r.score {op} b.threshold hit from (select {keys} step, case when step={steps - 1} then hi else lo+step*((hi-lo)/{steps - 1})
 end threshold from (select {keys} {lo} lo, {hi} hi from {source} {"group by " + by if by else ""}) z,
 (select unnest(range({steps})) step) y) b join {source} r on true {on}) group by all""",
        f"{keys} step, threshold,",
    )


VID = "select v.series_id, v.label, avg(s.score) score from scores s join videos v using (series_id) group by all"


def video_scores(spark, sf):
    means = S.series_mean(fx.scores(spark, sf)).withColumnRenamed("full_mean", "score")
    return means.join(fx.videos(spark, sf).select("series_id", "label"), "series_id")


def decided(spark, sf):
    return S.decide(video_scores(spark, sf), 0.4, "score")


_CONFUSION = """select count(*) filter (label=1 and p=1) tp, count(*) filter (label=0 and p=0) tn,
 count(*) filter (label=0 and p=1) fp, count(*) filter (label=1 and p=0) fn
 from (select *, case when score >= 0.4 then 1 else 0 end p from vid)"""


@query("confusion_metrics", f"{_COUNTS} {_RATES}", rates_sql(_CONFUSION), vid=VID)
def _(spark, sf):
    return M.confusion_metrics(decided(spark, sf))


@query("threshold_sweep", f"step:i threshold:d {_COUNTS} {_RATES}", sweep_sql("vid", 400), vid=VID)
def _(spark, sf):
    return M.threshold_sweep(video_scores(spark, sf))


@query(
    "threshold_sweep_unit", f"step:i threshold:d {_COUNTS} {_RATES}",
    sweep_sql("numbered", 200, lo="min(cast(0 as double))", hi="max(cast(1 as double))", op=">"),
)
def _(spark, sf):
    return M.threshold_sweep(fx.labelled_scores(spark, sf), 200, 0.0, 1.0, ">")


@query(
    "best_threshold", f"step:i threshold:d {_COUNTS} {_RATES}",
    "select * from (" + sweep_sql("vid", 400) + ") order by accuracy desc, f1 desc, balanced_accuracy desc, step limit 1",
    vid=VID,
)
def _(spark, sf):
    return M.best_threshold(M.threshold_sweep(video_scores(spark, sf)))


@query(
    "leaderboard", f"threshold:d {_COUNTS} {_RATES}",
    "select * from (" + sweep_sql("vid", 400) + ") order by accuracy desc, f1 desc, balanced_accuracy desc, threshold limit 20",
    vid=VID,
)
def _(spark, sf):
    return P.leaderboard(M.threshold_sweep(video_scores(spark, sf)))


KVID = f"""select k, t.series_id, label, avg(score) score from (select *, row_number() over (partition by series_id order by
 score desc, idx) rn from scores) t join videos using (series_id) join (select unnest({list(M.K_GRID)}) k) on rn <= k
 group by all"""


@query("topk_means", "series_id:i k:i video_score:d", "select series_id, k, score video_score from kvid", kvid=KVID)
def _(spark, sf):
    return M.topk_means(fx.scores(spark, sf), M.K_GRID)


@query(
    "grid_search_k_threshold", f"k:i step:i threshold:d {_COUNTS} {_RATES}", sweep_sql("kvid", 200, "k"), kvid=KVID,
)
def _(spark, sf):
    return M.grid_search_k_threshold(fx.scores(spark, sf), fx.videos(spark, sf))


_BOTH = """select v.series_id, v.label, f.score full_mean, coalesce(max(g.mean_score), 0) segment_mean_max from videos v
 join vid f using (series_id) left join segs g on g.series_id=v.series_id group by all"""
_LONG = """select 0 method, label, full_mean score from both_scores join calib using (series_id)
 union all select 1, label, segment_mean_max from both_scores join calib using (series_id)"""
_HASH = "md5(concat_ws(':', '42', series_id))"


def both_methods(spark, sf):
    """One row per series with both scores, the table calibration starts from."""
    scores = fx.scores(spark, sf)
    segments = S.segment_summary(scores, S.hysteresis_segments(scores, 0.5, 0.3, 3), "exclusive")
    return S.segment_mean_max(video_scores(spark, sf).withColumnRenamed("score", "full_mean"), segments)


@query(
    "calibrate_and_apply", "series_id:i label:i method:s threshold:d video_score:d prediction:i",
    """select b.series_id, b.label, case when w.method=0 then 'full_mean' else 'segment_mean_max' end as method, w.threshold,
 case when w.method=0 then full_mean else segment_mean_max end video_score,
 case when (case when w.method=0 then full_mean else segment_mean_max end) >= w.threshold then 1 else 0 end prediction
 from both_scores b, (select * from swept order by accuracy desc, f1 desc, balanced_accuracy desc, method, step limit 1) w""",
    hyst=HYSTERESIS, segs=SUMMARY, vid=VID, both_scores=_BOTH,
    calib=f"""select series_id from (select *, row_number() over (partition by label order by {_HASH}) rn from videos)
 where rn <= case when label=1 then 3 else 10 end""",
    long=_LONG, swept=sweep_sql("long", 400, "method"),
)
def _(spark, sf):
    chosen = P.balanced_sample(fx.videos(spark, sf).select("series_id", "label"), 3, 10)
    return M.calibrate_and_apply(both_methods(spark, sf), ["full_mean", "segment_mean_max"], chosen)


@query(
    "apply_calibration", "series_id:i label:i video_score:d prediction:i",
    """select series_id, label, score video_score, case when score >= (select threshold from best) then 1 else 0 end prediction
 from kvid where k = (select k from best)""",
    kvid=KVID,
    best="select * from (" + sweep_sql("kvid", 200, "k") + ") order by accuracy desc, f1 desc, balanced_accuracy desc, k, step limit 1",
)
def _(spark, sf):
    scores, videos = fx.scores(spark, sf), fx.videos(spark, sf)
    best = P.leaderboard(M.grid_search_k_threshold(scores, videos), 1)
    return M.apply_calibration(scores, videos, best)


# --- curves ----------------------------------------------------------------------------------------------------

def ladder_sql(source: str, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""select *, coalesce(sum(pos) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) pb,
 coalesce(sum(neg) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) nb,
 sum(pos) over ({part}) p, sum(neg) over ({part}) n from (select {keys} score, count(*) filter (label=1) pos,
 count(*) filter (label=0) neg from {source} group by all)"""


_COARSE = "select series_id, idx, round(score, 2) score, label from numbered"


def coarse(spark, sf):
    """Scores rounded to two places, so that many rows tie."""
    return fx.labelled_scores(spark, sf).withColumn("score", F.round("score", 2))


@query("roc_auc", "auc:d", "select sum(pos*(nb+neg/2))/(max(p)*max(n)) auc from (" + ladder_sql("numbered") + ")")
def _(spark, sf):
    return M.roc_auc(fx.labelled_scores(spark, sf))


@query(
    "roc_auc_ties", "auc:d", "select sum(pos*(nb+neg/2))/(max(p)*max(n)) auc from (" + ladder_sql("coarse") + ")", coarse=_COARSE,
)
def _(spark, sf):
    return M.roc_auc(coarse(spark, sf))


@query(
    "roc_curve", "threshold:d fpr:d tpr:d",
    "select score threshold, (n-nb)/n fpr, (p-pb)/p tpr from (" + ladder_sql("numbered") + ")",
)
def _(spark, sf):
    return M.roc_curve(fx.labelled_scores(spark, sf))


_PR = """select score threshold, (p-pb)/(p-pb+n-nb) as precision, (p-pb)/p recall,
 case when p-pb-pos+n-nb-neg > 0 then (p-pb-pos)/(p-pb-pos+n-nb-neg) else 1 end next_precision, (p-pb-pos)/p next_recall from ("""


@query("pr_curve", "threshold:d precision:d recall:d next_precision:d next_recall:d", _PR + ladder_sql("coarse") + ")", coarse=_COARSE)
def _(spark, sf):
    return M.pr_curve(coarse(spark, sf))


@query(
    "pr_auc", "pr_auc:d",
    "select sum((recall-next_recall)*(precision+next_precision)/2) pr_auc from (" + _PR + ladder_sql("numbered") + "))",
)
def _(spark, sf):
    return M.pr_auc(fx.labelled_scores(spark, sf))


@query(
    "micro_macro_auc", "micro_auc:d macro_auc:d n_series:i",
    """select (select sum(pos*(nb+neg/2))/(max(p)*max(n)) from (""" + ladder_sql("numbered") + """)) micro_auc,
 avg(auc) macro_auc, count(*) n_series from (select series_id, sum(pos*(nb+neg/2))/(max(p)*max(n)) auc from ("""
    + ladder_sql("anchored", "series_id") + ") group by 1)",
    anchored="""select series_id, score, label from numbered union all
 select distinct series_id, 0, 0 from numbered union all select distinct series_id, 1, 1 from numbered""",
)
def _(spark, sf):
    return M.micro_macro_auc(fx.labelled_scores(spark, sf))


# --- reports ---------------------------------------------------------------------------------------------------

@query(
    "classification_report", "name:s precision:d recall:d f1:d support:i",
    """select name, precision, recall, f1, support from per union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per
 union all select 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
 sum(f1*support)/sum(support), sum(support) from per""",
    vid=VID, c=_CONFUSION,
    per="""select name, case when h+w=0 then 0 else h/(h+w) end as precision, case when h+m=0 then 0 else h/(h+m) end recall,
 case when 2*h+w+m=0 then 0 else 2.0*h/(2*h+w+m) end f1, h+m support from (
 select '0' as name, tn h, fn w, fp m from c union all select '1', tp, fp, fn from c)""",
)
def _(spark, sf):
    return M.classification_report(decided(spark, sf))


_VERDICTS = """select case when video_type='anomalous' then 'anomalous' else 'normal' end ground_truth,
 correctness >= 3 is_anomalous, case when video_id%5<>0 then completeness*2 end anomaly_score, scene from judged"""


def verdicts(spark, sf):
    rows = fx.judged(spark, sf)
    return rows.select(
        F.when(F.col("video_type") == "anomalous", "anomalous").otherwise("normal").alias("ground_truth"),
        (F.col("correctness") >= 3).alias("is_anomalous"),
        F.when(F.col("video_id") % 5 != 0, F.col("completeness") * 2).alias("anomaly_score"), "scene",
    )


def _sens_spec(mode: str, p: str, n: str) -> None:
    @query(
        f"sens_spec_{mode}",
        "n_anomalous:i n_normal:i tp:i fn:i tn:i fp:i errors:i avg_anomalous_score:d avg_normal_score:d sensitivity:d specificity:d",
        f"""select *, case when {p}=0 then 0 else tp/({p}) end sensitivity, case when {n}=0 then 0 else tn/({n}) end specificity from (
 select count(*) filter (a) n_anomalous, count(*) filter (not a) n_normal, count(*) filter (a and is_anomalous) tp,
 count(*) filter (a and not is_anomalous) fn, count(*) filter (not a and not is_anomalous) tn,
 count(*) filter (not a and is_anomalous) fp, count(*) filter (is_anomalous is null) errors,
 coalesce(avg(anomaly_score) filter (a), 0) avg_anomalous_score, coalesce(avg(anomaly_score) filter (not a), 0) avg_normal_score
 from (select *, ground_truth='anomalous' a from verdicts))""",
        verdicts=_VERDICTS,
    )
    def _(spark, sf):
        return M.sens_spec(verdicts(spark, sf), mode)


_sens_spec("all", "n_anomalous", "n_normal")
_sens_spec("decided", "tp+fn", "tn+fp")


@query(
    "suggestibility", "scene:s n_valid:i fp:i tn:i errors:i fp_rate:d avg_score:d verdict:s",
    """select *, case when fp_rate > 0.3 then 'suggestible' when fp_rate > 0.1 then 'partially suggestible' else 'robust' end verdict
 from (select scene, count(is_anomalous) n_valid, count(*) filter (is_anomalous) fp, count(*) filter (not is_anomalous) tn,
 count(*) filter (is_anomalous is null) errors, case when count(is_anomalous)=0 then 0 else
 count(*) filter (is_anomalous)/count(is_anomalous) end fp_rate, coalesce(sum(anomaly_score) filter (is_anomalous is not null), 0)
 /greatest(1, count(is_anomalous)) avg_score from verdicts where ground_truth='normal' group by scene)""",
    verdicts=_VERDICTS,
)
def _(spark, sf):
    return M.suggestibility(verdicts(spark, sf).filter("ground_truth = 'normal'"), ["scene"])


@query(
    "gate_summary", "flagged:b n:i mean_score:d min_score:d max_score:d",
    """select score > 0.4 flagged, count(*) n, avg(score) mean_score, min(score) min_score, max(score) max_score
 from vid group by 1""",
    vid=VID,
)
def _(spark, sf):
    return M.gate_summary(S.gate(video_scores(spark, sf).withColumnRenamed("score", "gate_score"), 0.4))


@query(
    "detection_rate", "detected:i total:i rate:d mean_iou:d",
    """select count(*) filter (n > 0) detected, count(*) total, count(*) filter (n > 0)/count(*) rate,
 avg(iou) filter (iou > 0) mean_iou from (select v.series_id, coalesce(n, 0) n, 1.0/(1+v.n_snip%4) - 0.25 iou from videos v left join
 (select series_id, count(*) n from hyst where end_idx-start_idx >= 8 group by 1) using (series_id))""",
    hyst=HYSTERESIS,
)
def _(spark, sf):
    segments = S.hysteresis_segments(fx.scores(spark, sf), 0.5, 0.3, 8)
    counts = segments.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = fx.videos(spark, sf).join(counts, "series_id", "left")
    rows = rows.withColumn("iou", 1.0 / (1 + F.col("n_snip") % 4) - 0.25)
    return M.detection_rate(rows, F.col("n") > 0, "iou")
