"""Registered queries of prompts, manifests, splits, readers and the model hook."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from scorewise.functions import text
from scorewise.operators import chat as C
from scorewise.operators import matching as X
from scorewise.operators import sampling as P
from scorewise.operators import scoring, splits
from scorewise.operators import series as S
from scorewise.operators import vectors as V
from scorewise.sources import array_files, readers, writers
from scorewise.sources.shared import shared_folder, written

from . import fixtures as fx
from .registry import query
from .sampling_queries import POOL, SPAN_STEPS, UNION_SQL, picks_steps, window_rows
from .series_queries import runs_sql
from .vector_queries import _SIMS, _SPLIT, topk

VARIANTS = ("frames_only", "frames_plus_score", "score")
_HASH = "md5(concat_ws(':', '42', {0}))"


def scratch(spark, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/scorewise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# --- text ------------------------------------------------------------------------------------------------------

_LISTED = "select series_id, list(struct_pack(idx := idx, score := score) order by idx) p from scores group by 1"


def listed(spark, sf):
    """All scores of a series as one array: recordings of the stand-in have some dozens of snippets."""
    return fx.scores(spark, sf).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("p"))


@query(
    "score_text", "series_id:i plain:s snippets:s frames:s",
    """select series_id, list_aggregate(list_transform(p, lambda x: printf('%.4f', x.score)), 'string_agg', ', ') plain,
 list_aggregate(list_transform(p, lambda x: printf('snippet %d=%.3f', x.idx, x.score)), 'string_agg', ', ') snippets,
 list_aggregate(list_transform(p, lambda x: printf('frame %d=%.2f', x.idx, x.score)), 'string_agg', ', ') frames from arrays""",
    arrays=_LISTED,
)
def _(spark, sf):
    p = F.col("p")
    return listed(spark, sf).select(
        "series_id", text.score_text(F.transform(p, lambda x: x["score"])).alias("plain"),
        text.labelled_score_text(p, "snippet", 3).alias("snippets"), text.labelled_score_text(p, "frame", 2).alias("frames"),
    )


_RAW = r"""select doc_id, case doc_id%8 when 0 then '```json' || chr(10) || '{"explanation": "' || lang || ' ' || source || '"}' || chr(10) || '```'
 when 1 then '  {"explanation": "' || source || '"} ' when 2 then '```{"explanation": "' || lang || '"}```'
 when 3 then '{"other": 1}' when 5 then '{"explanation": "' || source || '"} and more' when 6 then '{''explanation'': ''' || source || '''}'
 when 7 then '{"explanation": "' || source || '"}, {"explanation": "x"}' else text end raw, lang, source, text from documents"""


def raw_replies(spark, sf):
    kind = F.col("doc_id") % 8
    said = lambda v: F.concat(F.lit('{"explanation": "'), v, F.lit('"}'))
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), said(F.concat_ws(" ", "lang", "source")), F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("  "), said(F.col("source")), F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("```"), said(F.col("lang")), F.lit("```")))
        .when(kind == 3, F.lit('{"other": 1}'))
        .when(kind == 5, F.concat(said(F.col("source")), F.lit(" and more")))
        .when(kind == 6, F.concat(F.lit("{'explanation': '"), "source", F.lit("'}")))
        .when(kind == 7, F.concat(said(F.col("source")), F.lit(', {"explanation": "x"}'))).otherwise(F.col("text"))
    )
    return fx.table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


@query(
    "parse_reply", "doc_id:i explanation:s",
    """select doc_id, case doc_id%8 when 0 then lang || ' ' || source when 1 then source when 2 then lang
 when 4 then trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) else raw end explanation from raws""",
    raws=_RAW,
)
def _(spark, sf):
    return raw_replies(spark, sf).select("doc_id", text.parse_reply(F.col("raw")).alias("explanation"))


@query(
    "turn_label", "video_id:i label:s",
    "select conv_id video_id, coalesce(arg_min(text, turn) filter (role='assistant'), '') as label from conversations group by 1",
)
def _(spark, sf):
    return fx.turns(spark, sf).select("video_id", text.turn_label(F.col("conversations")).alias("label"))


@query(
    "turn_label_strict", "video_id:i label:s",
    """select conv_id video_id, case conv_id%4 when 0 then 'said ' || conv_id when 1 then '{"explanation": "said ' || conv_id || '"} trailing'
 when 2 then '{''explanation'': ''said ' || conv_id || '''}' else '{"other": ' || conv_id || '}' end as label from conversations group by 1""",
)
def _(spark, sf):
    """Turns in strict JSON, in JSON with text after it, in single quotes, and without the key."""
    kind, said = F.col("video_id") % 4, F.concat(F.lit("said "), F.col("video_id").cast("string"))
    value = (
        F.when(kind == 0, F.concat(F.lit(' {"explanation": "'), said, F.lit('"}\n')))
        .when(kind == 1, F.concat(F.lit('{"explanation": "'), said, F.lit('"} trailing')))
        .when(kind == 2, F.concat(F.lit("{'explanation': '"), said, F.lit("'}")))
        .otherwise(F.concat(F.lit('{"other": '), F.col("video_id").cast("string"), F.lit("}")))
    )
    talks = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id")).distinct()
    turns = F.array(*[F.struct(F.lit(who).alias("from"), said.alias("value")) for who, said in (("user", F.lit("why?")), ("assistant", value))])
    return talks.select("video_id", text.turn_label(turns).alias("label"))


@query(
    "judge_prompt", "video_id:i prompt:s",
    """select video_id, 'HUMAN ground-truth explanation:' || chr(10) || '"' || scene || '"' || chr(10) || chr(10) ||
 'AI-generated explanation:' || chr(10) || '"' || text || '"' prompt from judged""",
)
def _(spark, sf):
    return fx.judged(spark, sf).select("video_id", text.judge_prompt(F.col("scene"), F.col("text")).alias("prompt"))


@query(
    "parse_judgement", "video_id:i correctness:i specificity:i completeness:i fluency:i justification:s",
    """select video_id, case when video_id%9 in (0, 1, 4) then null else correctness end correctness,
 case when video_id%9 not in (0, 4) then specificity end specificity, case when video_id%9 not in (0, 4) then completeness end completeness,
 case when video_id%9 not in (0, 4) then fluency end fluency,
 case when video_id%9=0 then 'ERROR: no answer' when video_id%9=4 then 'ERROR: {"correctness":3} so be it' else scene end justification from judged""",
)
def _(spark, sf):
    """Of nine replies one is no JSON, one goes on after it, one rates outside the scale, and two write ratings as texts or
    with a decimal point."""
    kind = F.col("video_id") % 9
    rated = lambda form: F.to_json(F.struct(
        F.when(kind == 1, 9).otherwise(F.col("correctness")).cast(form).alias("correctness"),
        *[F.col(c).cast(form).alias(c) for c in ("specificity", "completeness", "fluency")], F.col("scene").alias("justification"),
    ))
    reply = (
        F.when(kind == 0, "no answer").when(kind == 4, '{"correctness":3} so be it').when(kind == 2, rated("double"))
        .when(kind == 3, rated("string")).otherwise(rated("int"))
    )
    rows = fx.judged(spark, sf).select("video_id", text.parse_judgement(reply).alias("j"))
    return rows.select("video_id", "j.*")


# --- prompts ---------------------------------------------------------------------------------------------------

_SPAN = """select series_id, 0 seg_no, min(idx) start_idx, max(idx) end_idx from (select *, row_number() over (partition by series_id
 order by score desc, idx) rn from scores) where rn <= 8 group by 1"""
_PICKED = """select series_id, list(struct_pack(idx := idx, score := score) order by idx) p, any_value(start_idx) a, any_value(end_idx) b
 from picks join span using (series_id) group by 1"""


def picked_spans(spark, sf):
    """The top-score span of each series with its picks: at most a budget of rows per series."""
    scores = fx.scores(spark, sf)
    span = S.topk_span(scores, 8).withColumn("seg_no", F.lit(0))
    picks = P.budget_sample(scores, span)
    gathered = picks.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("p"))
    return gathered.join(span.drop("seg_no"), "series_id")


@query(
    "video_prompt", "series_id:i prompt:s",
    """select series_id, 'Recording of ' || n_snip || ' snippets; suspicious parts: [' ||
 case when series_id%4=0 then 'unknown' else printf('snippets %d-%d', a, b) end || ']; overall rating ' || printf('%.3f', g) ||
 '; stills attached: ' || len(p) || ', rated [' ||
 list_aggregate(list_transform(p, lambda x: printf('snippet %d=%.3f', x.idx, x.score)), 'string_agg', ', ') || '].' prompt
 from picked join videos using (series_id) join (select series_id, max(score) g from scores group by 1) using (series_id)""",
    span=_SPAN, **picks_steps("scores", "select * from span"), picked=_PICKED,
)
def _(spark, sf):
    top = fx.scores(spark, sf).groupBy("series_id").agg(F.max("score").alias("gate_score"))
    rows = picked_spans(spark, sf).join(top, "series_id").join(fx.videos(spark, sf).select("series_id", "n_snip"), "series_id")
    segment = F.struct(F.col("start_idx").alias("start_snippet"), F.col("end_idx").alias("end_snippet"))
    segments = F.when(F.col("series_id") % 4 != 0, F.array(segment))
    return rows.select("series_id", C.video_prompt(F.col("n_snip"), segments, F.col("gate_score"), F.col("p")).alias("prompt"))


@query(
    "segment_prompt", "series_id:i variant:s prompt:s",
    """select series_id, variant, printf('Excerpt from frame %d up to %d, %d in all; stills attached: %d.', a, b+1, b+1-a, len(p)) ||
 case when variant <> 'frames_only' then ' Ratings: [' || list_aggregate(list_transform(p, lambda x:
 printf('frame %d=%.2f', x.idx, x.score)), 'string_agg', ', ') || '].' else '' end || case when variant='frames_score_heatmap' then
 ' After every still comes a map of where the rating stems from.' else '' end prompt
 from picked, (select unnest(['frames_only', 'frames_plus_score', 'frames_score_heatmap']) variant)""",
    span=_SPAN, **picks_steps("scores", "select * from span"), picked=_PICKED,
)
def _(spark, sf):
    variants = F.explode(F.array(*[F.lit(v) for v in ("frames_only", "frames_plus_score", "frames_score_heatmap")]))
    rows = picked_spans(spark, sf).withColumn("variant", variants)
    prompt = C.segment_prompt(F.col("variant"), F.col("start_idx"), F.col("end_idx") + 1, F.col("p"))
    return rows.select("series_id", "variant", prompt.alias("prompt"))


_TEXT4 = "list_aggregate(list_transform({0}, lambda x: printf('%.4f', x)), 'string_agg', ', ')"


def _thin(scores: str, k: int) -> str:
    return f"""(case when len({scores}) <= {k} then {scores} else list_transform(list_sort(list_distinct(list_transform(range({k}),
 lambda i: cast(round_even(i*(len({scores})-1)/{k - 1}.0, 0) as bigint)))), lambda i: {scores}[i+1]) end)"""


@query(
    "retrieval_prompt", "query_id:i n_examples:i prompt:s",
    f"""select t.query_id, coalesce(n, 0) n_examples, 'Answered cases to learn from: ' || coalesce(n, 0) || '. Answer the open one likewise.'
 || chr(10) || coalesce(parts, '') || chr(10) || chr(10) || '[open case]' || chr(10) || 'snippets: ' || n_snip || ', overall rating: '
 || printf('%.3f', g) || chr(10) || 'ratings: [' || {_TEXT4.format(_thin("s.sc", 12))} || ']' || chr(10) || 'answer:' prompt from (select distinct query_id from ranked) t join sc s on s.series_id=t.query_id
 join (select series_id, count(*) n_snip, max(score) g from scores group by 1) z on z.series_id=t.query_id
 left join (select query_id, count(*) n, string_agg(chr(10) || '[case ' || rank ||
 ', likeness ' || case when sim is null then 'n/a' else printf('%.3f', sim) end || ']' || chr(10) || 'ratings: [' ||
 {_TEXT4.format(_thin("s.sc", 4))} || ']' || chr(10) || 'answer: "label ' || index_id || '"', chr(10) order by rank) parts
 from ranked join sc s on s.series_id=index_id where rank <= 3 group by 1) e on e.query_id=t.query_id""",
    **_SPLIT, ranked=_SIMS,
    sc="select series_id, list(score order by idx) sc from scores group by 1",
)
def _(spark, sf):
    rows = listed(spark, sf).select("series_id", F.transform("p", lambda x: x["score"]).alias("scores"))
    facts = fx.scores(spark, sf).groupBy("series_id").agg(F.count("*").alias("n_snip"), F.max("score").alias("gate_score"))
    asked = rows.join(facts, "series_id").withColumnRenamed("series_id", "query_id")
    label = F.concat(F.lit("label "), F.col("series_id").cast("string"))
    examples = rows.select(F.col("series_id").alias("index_id"), "scores", label.alias("label"))
    ranked = topk(spark, sf)
    return C.retrieval_prompt(asked.join(ranked.select("query_id").distinct(), "query_id", "left_semi"), ranked, examples)


# --- manifests -------------------------------------------------------------------------------------------------

def pooled(spark, sf):
    """The frames of every strategy, as a table in the shared folder: manifests are built from stored pools."""
    return written(P.run_strategies(window_rows(spark, sf)).select("series_id", "strategy", "frame", "score"), "pooled")


def labels(spark, sf):
    said = F.when(F.col("series_id") % 6 != 0, F.concat(F.lit("label "), F.col("series_id").cast("string"))).otherwise(F.lit("  "))
    return fx.annotations(spark, sf).select("series_id", said.alias("explanation"))


def manifest(spark, sf, max_frames=16):
    return C.build_manifest(pooled(spark, sf), labels(spark, sf), max_frames)


_MANIFEST_STEPS = dict(
    **POOL, **SPAN_STEPS, pooled=UNION_SQL,
    listed="select series_id, strategy, list(struct_pack(frame := frame, score := score) order by frame) p from pooled where series_id%6<>0 group by 1, 2",
)


def _thinned(k: int) -> str:
    return f"""select series_id, strategy, case when len(p) <= {k} then p else list_transform(list_sort(list_distinct(list_transform(range({k}),
 lambda i: cast(round_even(i*(len(p)-1)/{k - 1}.0, 0) as bigint)))), lambda i: p[i+1]) end p from listed"""


_HUMAN = """rtrim(repeat('<image>' || chr(10), len(p)), chr(10)) || chr(10) || 'Detector ratings of the stills, earliest first: [' ||
 list_aggregate(list_transform(p, lambda x: printf('%.4f', x.score)), 'string_agg', ', ') || ']' || chr(10) || 'What is unusual here?'"""
_ROW = "id:s video_id:s human:s answer:s images:s"


@query(
    "build_manifest", _ROW,
    f"""select series_id || '_' || strategy id, series_id video_id, {_HUMAN} human, '{{"explanation":"label ' || series_id || '"}}' answer,
 list_aggregate(list_transform(range(1, len(p)+1), lambda j: 'images/' || series_id || '/' || strategy || printf('/f%03d_frm%05d.jpg', j-1,
 cast(p[j].frame as bigint))), 'string_agg', ',') images from ({_thinned(16)})""",
    **_MANIFEST_STEPS,
)
def _(spark, sf):
    rows = manifest(spark, sf)
    return rows.select(
        "id", "video_id", F.get("conversations", F.lit(0))["value"].alias("human"),
        F.get("conversations", F.lit(1))["value"].alias("answer"), F.array_join("images", ",").alias("images"),
    )


@query(
    "to_messages", "id:s roles:s user:s n_images:i",
    f"""select series_id || '_' || strategy id, 'system,user,assistant' roles, {_HUMAN} as user, len(p) n_images from (
 select series_id, strategy, case when len(p) <= 6 then p else list_transform(list_sort(list_distinct(list_transform(range(6),
 lambda i: cast(round_even(i*(len(p)-1)/5.0, 0) as bigint)))), lambda i: p[i+1]) end p from ({_thinned(16)}))""",
    **_MANIFEST_STEPS,
)
def _(spark, sf):
    rows = C.to_messages(manifest(spark, sf), 6)
    return rows.select(
        "id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.get("messages", F.lit(1))["content"].alias("user"), F.size("images").alias("n_images"),
    )


@query(
    "relabel", "id:s answer:s",
    f"""select series_id || '_' || strategy id, '{{"explanation":"new ' || series_id || '"}}' answer from ({_thinned(16)})
 where series_id%5<>0""",
    **_MANIFEST_STEPS,
)
def _(spark, sf):
    fresh = fx.videos(spark, sf).filter("series_id % 5 <> 0").select(
        F.col("series_id").cast("string").alias("video_id"), F.concat(F.lit("new "), F.col("series_id").cast("string")).alias("explanation")
    )
    rows = X.relabel(manifest(spark, sf), fresh)
    return rows.select("id", F.get("conversations", F.lit(1))["value"].alias("answer"))


@query(
    "unlabelled", "video_id:s",
    "select distinct series_id video_id from listed where series_id%5=0", **_MANIFEST_STEPS,
)
def _(spark, sf):
    fresh = fx.videos(spark, sf).filter("series_id % 5 <> 0").select(F.col("series_id").cast("string").alias("video_id"))
    return X.unlabelled(manifest(spark, sf), fresh)


@query(
    "build_negatives", "id:s label:s frames:s scores:s",
    f"""select 'normal_' || series_id id, (['Everything seen here is everyday behaviour.', 'Nothing out of the ordinary happens.',
 'People and vehicles move as expected throughout.'])[pos%3+1] as label, string_agg(cast(frame as varchar), ',' order by frame) frames,
 string_agg(printf('%.4f', score), ', ' order by frame) scores from (select v.series_id, pos, frame, score from (select *,
 row_number() over (order by {_HASH.format("series_id")}, series_id) pos,
 unnest(list_distinct(list_transform(range(5), lambda i: cast(round_even(i*(n_frames-1)/4.0, 0) as bigint)))) frame from normals) v
 join scores s on s.series_id=v.series_id and s.idx=least(n_snip-1, cast(floor(frame/n_frames*n_snip) as bigint))) group by series_id, pos""",
    normals="select * from videos where label=0",
)
def _(spark, sf):
    normals = fx.videos(spark, sf).filter("label = 0")
    rows = C.build_negatives(normals, fx.scores(spark, sf))
    return rows.select(
        "id", text.turn_label(F.col("conversations")).alias("label"), F.array_join("frame_indices", ",").alias("frames"),
        text.score_text(F.col("scores")).alias("scores"),
    )


@query(
    "prefer_strategy", "series_id:i frame:i score:d",
    """select p.series_id, frame, score from kept p join (select series_id, arg_min(strategy, case when strategy='human_span_smart'
 then '0' else strategy end) strategy from kept group by 1) using (series_id, strategy)""",
    **POOL, **SPAN_STEPS, pooled=UNION_SQL,
    kept="select * from pooled where not (strategy='human_span_smart' and series_id%2=0)",
)
def _(spark, sf):
    kept = pooled(spark, sf).filter("not (strategy = 'human_span_smart' and series_id % 2 = 0)")
    return X.prefer_strategy(kept, "human_span_smart")


# --- splits ----------------------------------------------------------------------------------------------------

_SIDE = """select j.*, case when rn <= take then 'eval' else 'train' end split from judged j join (select video_id,
 row_number() over ({part} order by """ + _HASH.format("video_id") + """, video_id) rn,
 greatest(1, cast(round_even(count(*) over ({part})*0.15, 0) as bigint)) take from judged) using (video_id)"""


@query("group_split", "video_id:i split:s", "select video_id, split from (" + _SIDE.format(part="") + ")")
def _(spark, sf):
    return splits.group_split(fx.judged(spark, sf).select("video_id"))


@query(
    "group_split_stratified", "video_id:i video_type:s split:s",
    "select video_id, video_type, split from (" + _SIDE.format(part="partition by video_type") + ")",
)
def stratified(spark, sf):
    return splits.group_split(fx.judged(spark, sf).select("video_id", "video_type"), by=["video_type"])


@query(
    "split_report", "split:s video_type:s n_rows:i n_videos:i",
    "select split, video_type, count(*) n_rows, count(distinct video_id) n_videos from ("
    + _SIDE.format(part="partition by video_type") + ") group by 1, 2",
)
def _(spark, sf):
    return splits.split_report(stratified(spark, sf), ["video_type"])


@query(
    "positional_split", "page_id:i split:s",
    "select page_id, case when page_id < 63 then 'abnormal' else 'normal' end split from pages",
)
def _(spark, sf):
    return splits.positional_split(fx.table(spark, sf, "pages").select("page_id"), 63, "page_id")


# --- readers and writers ---------------------------------------------------------------------------------------

def _lines(spark, sf, layout):
    extra = [] if layout == "test" else [F.lit("x")]
    fields = [F.concat(F.lit("/data/clips/"), F.col("series_id").cast("string")), *extra, F.col("n_frames"), F.col("label")]
    train = F.lit(layout == "train")
    fields[0] = F.concat(fields[0], F.when((F.col("series_id") % 4 == 1) & train, "/").otherwise(""))
    cut = (F.col("series_id") % 10 == 3) & train
    line = F.when(cut, F.concat_ws(" ", *fields[:2])).otherwise(F.concat(F.lit("  "), F.concat_ws(" \t ", *fields)))
    return fx.videos(spark, sf).select(line.alias("value"))


def _video_list(layout: str) -> None:
    @query(
        f"read_video_list_{layout}", "video_id:s n_frames:i label:i",
        "select series_id video_id, n_frames, label from videos" + " where series_id%10<>3" * (layout == "train"),
    )
    def _(spark, sf):
        path = scratch(spark, "list")
        _lines(spark, sf, layout).write.text(path)
        return readers.read_video_list(spark, path, layout)


_video_list("test")
_video_list("train")


@query("read_id_list", "video_id:s", "select series_id video_id from videos")
def _(spark, sf):
    path = scratch(spark, "ids")
    line = F.concat(F.lit("/data/features/"), F.col("series_id").cast("string"), F.lit("_i3d.npy"))
    fx.videos(spark, sf).select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return readers.read_id_list(spark, path).select("video_id")


@query(
    "read_annotations", "video_id:s explanation:s anomaly_start_frame:i anomaly_end_frame:i",
    """select series_id video_id, 'label ' || series_id explanation, start_frame anomaly_start_frame, end_frame anomaly_end_frame
 from annotations where series_id%6<>0""",
)
def _(spark, sf):
    path = scratch(spark, "annotations")
    rows = fx.annotations(spark, sf).join(labels(spark, sf), "series_id")
    rows.select(
        F.col("series_id").cast("string").alias("video_id"), "explanation", F.col("start_frame").alias("anomaly_start_frame"),
        F.col("end_frame").alias("anomaly_end_frame"),
    ).write.json(path)
    return readers.read_annotations(spark, path, drop_blank=True, lines=True)


@query(
    "manifest_round_trip", "id:s n_images:i",
    f"select series_id || '_' || strategy id, len(p) n_images from ({_thinned(16)})", **_MANIFEST_STEPS,
)
def _(spark, sf):
    path = scratch(spark, "manifest")
    writers.write_manifest(manifest(spark, sf), path)
    return readers.read_manifest(spark, path).select("id", F.size("images").alias("n_images"))


@query(
    "write_report", "run_tag:s n_videos:i n_anomalous:i mean_fluency:d",
    "select 'a' run_tag, count(*) n_videos, count(*) filter (video_type='anomalous') n_anomalous, avg(fluency) mean_fluency from judged",
)
def _(spark, sf):
    summary = [F.count_if(F.col("video_type") == "anomalous").alias("n_anomalous"), F.avg("fluency").alias("mean_fluency")]
    return writers.write_report(fx.judged(spark, sf).drop("text"), scratch(spark, "report"), "a", summary)


@query(
    "usable_ratings", "video_id:i",
    "select video_id from judged where correctness is not null and fluency is not null and video_id%7<>0",
)
def _(spark, sf):
    cells = fx.judged(spark, sf).select(
        "video_id", F.col("correctness").cast("string").alias("c"),
        F.when(F.col("video_id") % 7 == 0, " ").otherwise(F.col("fluency").cast("string")).alias("f"),
    )
    return readers.usable_ratings(cells, ["c", "f"])


@query(
    "variant_of", "doc_id:i variant:s",
    """select doc_id, case doc_id%3 when 0 then 'frames_only' when 1 then 'score_frames_only' end as variant from documents""",
)
def _(spark, sf):
    names = F.element_at(F.array(F.lit("frames_only"), F.lit("score_frames_only"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    file = F.concat(F.col("doc_id").cast("string"), F.lit("_"), names, F.lit(".json"))
    rows = fx.table(spark, sf, "documents").select("doc_id", file.alias("file"))
    return rows.select("doc_id", readers.variant_of(F.col("file"), ["frames_only", "score_frames_only"]).alias("variant"))


_FILES = """select c_nationkey folder, case when c_custkey%5=0 then 'Frame_' || c_custkey || '.PNG' when c_custkey%7=0 then c_custkey || '.txt'
 else c_custkey || '.jpg' end file from customer"""


def image_files(spark, sf):
    key = F.col("c_custkey").cast("string")
    name = (
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Frame_"), key, F.lit(".PNG")))
        .when(F.col("c_custkey") % 7 == 0, F.concat(key, F.lit(".txt"))).otherwise(F.concat(key, F.lit(".jpg")))
    )
    return fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("folder"), name.alias("file"))


@query(
    "frame_listing", "folder:i file:s pos:i",
    """select folder, file, row_number() over (partition by folder order by starts_with(file, 'F'), try_cast(split_part(file, '.', 1) as bigint),
 lower(file))-1 pos from files where not ends_with(file, '.txt')""",
    files=_FILES,
)
def _(spark, sf):
    return readers.frame_listing(image_files(spark, sf))


@query(
    "file_inventory", "ext:s n:i examples:s",
    """select ext, count(*) n, list_aggregate(list(file order by file)[1:3], 'string_agg', ',') examples from (select *,
 lower('.' || split_part(file, '.', 2)) ext from files) group by 1""",
    files=_FILES,
)
def _(spark, sf):
    return readers.file_inventory(image_files(spark, sf)).withColumn("examples", F.array_join("examples", ","))


@query(
    "resolve_frame", "series_id:i frame:i file:s",
    """select series_id, frame, case when frame%3=0 then printf('%03d.jpg', frame) when frame%3=1 then printf('%04d.jpg', frame) end file
 from frame_labels""",
)
def _(spark, sf):
    frames = fx.frame_labels(spark, sf).select("series_id", "frame")
    three = F.when(F.col("frame") % 3 == 0, F.array(F.format_string("%03d.jpg", "frame"), F.format_string("%04d.jpg", "frame")))
    files = frames.select("series_id", F.explode(three.when(F.col("frame") % 3 == 1, F.array(F.format_string("%04d.jpg", "frame")))).alias("file"))
    return X.resolve_frame(frames, files)


# --- model hook ------------------------------------------------------------------------------------------------

@query(
    "score_batches", "doc_id:i n:i answer:s",
    """select doc_id, case when doc_id%97<>0 then length(text) end n, case when doc_id%97=0 then 'ERROR: refused' else upper(lang) end answer
 from documents""",
)
def _(spark, sf):
    def load():
        """Stand-in model: text length and upper-case language; refuses every 97th document."""

        def model(rows):
            if (rows["doc_id"] % 97 == 0).any():
                raise ValueError("refused")
            return pd.DataFrame({"n": rows["text"].str.len(), "answer": rows["lang"].str.upper()})

        return model

    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return scoring.score_batches(docs, load, "n DOUBLE, answer STRING")


# --- readers over written files --------------------------------------------------------------------------------

@query("read_series", "series_id:i idx:i score:d", "select * from scores")
def _(spark, sf):
    path = scratch(spark, "series")
    fx.scores(spark, sf).write.parquet(path)
    return readers.read_series(spark, path)


@query("read_series_arrays", "series_id:i idx:i score:d", "select * from scores")
def _(spark, sf):
    path = scratch(spark, "series")
    listed(spark, sf).select("series_id", F.transform("p", lambda x: x["score"]).alias("scores")).write.parquet(path)
    return readers.read_series(spark, path)


@query(
    "read_annotations_last", "video_id:s explanation:s anomaly_start_frame:i anomaly_end_frame:i",
    """select series_id video_id, 'last ' || series_id explanation, start_frame anomaly_start_frame, end_frame anomaly_end_frame from annotations""",
)
def _(spark, sf):
    """Two entries for each recording, the first of which is outdated."""
    path = scratch(spark, "annotations")
    entry = lambda word: F.struct(
        F.col("series_id").cast("string").alias("video_id"), F.concat(F.lit(word), F.col("series_id").cast("string")).alias("explanation"),
        F.col("start_frame").alias("anomaly_start_frame"), F.col("end_frame").alias("anomaly_end_frame"),
    )
    fx.annotations(spark, sf).select(F.inline(F.array(entry("first "), entry("last ")))).write.json(path)
    return readers.read_annotations(spark, path, lines=True)


@query(
    "read_annotations_array", "video_id:s explanation:s anomaly_start_frame:i anomaly_end_frame:i",
    r"""select series_id video_id, 'has "quotes", {braces} and \ last ' || series_id explanation, start_frame anomaly_start_frame,
 end_frame anomaly_end_frame from annotations""",
)
def _(spark, sf):
    """One array in one file, two entries for each recording, the first of which is outdated."""
    path = scratch(spark, "array")
    entry = lambda word: F.to_json(F.struct(
        F.col("series_id").cast("string").alias("video_id"),
        F.concat(F.lit(r'has "quotes", {braces} and \ ' + word), F.col("series_id").cast("string")).alias("explanation"),
        F.col("start_frame").alias("anomaly_start_frame"), F.col("end_frame").alias("anomaly_end_frame"),
        F.array(F.struct(F.lit("}").alias("n"))).alias("nested"),
    ))
    rows = fx.annotations(spark, sf).select(F.posexplode(F.array(entry("first "), entry("last "))).alias("at", "value"))
    lines = rows.select(F.lit(1).alias("part"), "at", F.concat(F.lit(",\n"), "value").alias("value"))
    edge = lambda part, value: spark.range(1).select(F.lit(part).alias("part"), F.lit(0).alias("at"), F.lit(value).alias("value"))
    head = edge(0, '[{"explanation": "an entry without an id"}')
    # one file is one stream of text
    ordered = head.unionByName(lines).unionByName(edge(2, "\n]")).coalesce(1).sortWithinPartitions("part", "at")
    ordered.select("value").write.option("lineSep", " ").text(path)
    return readers.read_annotations(spark, path)


@query("append_done", "video_id:i scene:i", "select series_id video_id, scene from videos")
def _(spark, sf):
    """Two runs share ids, and the first is repeated."""
    path = scratch(spark, "done")
    rows = fx.videos(spark, sf).select(F.col("series_id").alias("video_id"), "scene")
    for run, part in (("one", rows.filter("video_id % 2 = 0")), ("two", rows), ("one", rows.filter("video_id % 2 = 0"))):
        writers.append_done(part, path, run)
    return writers.read_done(spark, path)


@query("read_series_npy", "series_id:i idx:i score:d", "select * from scores")
def _(spark, sf):
    """One array file per series."""
    path = scratch(spark, "npy")
    array_files.write_arrays(fx.scores(spark, sf), path)
    return readers.read_series(spark, path, "npy")


@query(
    "read_variant_outputs", "video_id:s variant:s explanation:s frames_sampled:i",
    """select series_id video_id, case series_id%3 when 0 then 'frames_only' when 1 then 'frames_plus_score' else 'score' end variant,
 'seen ' || series_id explanation, n_snip frames_sampled from videos where series_id%7<>0""",
)
def _(spark, sf):
    """A file per recording, named by its variant; every seventh has a name of no variant."""
    path = scratch(spark, "variants")
    variant = F.element_at(F.array(*map(F.lit, VARIANTS)), (F.col("series_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("series_id") % 7 == 0, "notes").otherwise(variant)
    made = fx.videos(spark, sf).select(
        F.concat(F.col("series_id").cast("string"), F.lit("_"), kind, F.lit(".json")).alias("name"),
        F.to_json(F.struct(
            F.col("series_id").cast("string").alias("video_id"), F.concat(F.lit("seen "), F.col("series_id").cast("string")).alias("explanation"),
            F.col("n_snip").alias("frames_sampled"),
        )).alias("content"),
    )
    writers.write_texts(made, path)
    return readers.read_variant_outputs(spark, path, VARIANTS)


@query(
    "read_metadata_tree", "video_id:s start_snippet:i end_snippet:i n_shots:i",
    """select series_id video_id, a start_snippet, b end_snippet, len(list_filter(p, lambda x: x.idx % 3 <> 0)) n_shots from picked
 where len(list_filter(p, lambda x: x.idx % 3 <> 0)) > 0""",
    span=_SPAN, **picks_steps("scores", "select * from span"), picked=_PICKED,
)
def _(spark, sf):
    """A file per recording in a folder of its own; half of them spell the segment bounds the short way."""
    path = scratch(spark, "tree")
    long = F.col("series_id") % 2 == 0
    bound = lambda c, name: F.when(long if "_" in name else ~long, F.col(c)).cast("int").alias(name)
    segment = F.struct(
        bound("start_idx", "start_snippet"), bound("end_idx", "end_snippet"), bound("start_idx", "start"), bound("end_idx", "end")
    )
    file = lambda p: F.when(p["idx"] % 3 != 0, F.concat(p["idx"].cast("string"), F.lit(".jpg")))
    shots = F.transform("p", lambda p: F.struct(p["idx"].cast("int").alias("snippet_idx"), p["score"].alias("score"), file(p).alias("file")))
    rows = picked_spans(spark, sf).select(
        F.col("series_id").alias("folder"), F.col("series_id").cast("string").alias("video_id"),
        F.array(segment).alias("anomalous_segments"), shots.alias("extracted_frames"),
    )
    rows.repartition("folder").write.partitionBy("folder").json(path)
    tree = readers.read_metadata_tree(spark, path, "part-*.json")
    return tree.select("video_id", F.inline("anomalous_segments"), F.size("extracted_frames").alias("n_shots"))


@query(
    "file_table", "folder:s n:i", "select 'c_nationkey=' || c_nationkey folder, 1 n from customer group by c_nationkey",
)
def _(spark, sf):
    """Files as they are on disk: one in each folder of a written table."""
    path = scratch(spark, "files")
    fx.table(spark, sf, "customer").select("c_nationkey", "c_custkey").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    files = readers.file_table(spark, path).filter((readers.extension(F.col("file")) == ".parquet") & (F.col("length") > 0))
    return files.groupBy("folder").agg(F.count("*").alias("n"))


@query("check_references_raising", "doc_id:i", "select doc_id from labels")
def _(spark, sf):
    """Raises when a label has no document; else the labels."""
    labelled = fx.table(spark, sf, "labels").select("doc_id")
    readers.check_references(labelled, fx.table(spark, sf, "documents"), "doc_id")
    return labelled
