"""Registered queries of judged-run analysis and joins between runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scorewise.functions import ids
from scorewise.functions.text import CRITERIA, valid_text
from scorewise.operators import judged as J
from scorewise.operators import matching as X
from scorewise.sources import readers
from scorewise.sources.readers import RATINGS
from scorewise.sources.shared import shared_folder

from . import fixtures as fx
from .registry import query

_C = ", ".join(CRITERIA)
RUNS = f"""select 'a' as variant, video_id, video_type, scene, {_C} from judged union all
 select 'b', video_id, video_type, scene, {_C} from judged_b union all
 select 'c', video_id, video_type, scene, correctness, fluency, completeness, specificity from judged_b where video_id%3<>0"""


def runs(spark, sf):
    """Three runs: two judged ones and a third that swaps two criteria and misses some ids."""
    a, b = fx.judged(spark, sf).drop("text"), fx.judged_b(spark, sf).drop("text")
    swap = {"specificity": F.col("fluency"), "fluency": F.col("specificity")}
    c = b.filter("video_id % 3 <> 0").withColumns(swap)
    tagged = [df.withColumn("variant", F.lit(v)) for v, df in (("a", a), ("b", b), ("c", c))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def overalls(spark, sf):
    rows = runs(spark, sf).withColumn("overall", J.row_overall())
    return rows.filter("overall is not null").select("variant", "video_id", "overall")


_ROW = "(correctness+specificity+completeness+fluency)/4.0"
OVERALLS = f"select variant, video_id, {_ROW} overall from runs where {_ROW} is not null"


# --- criterion summaries ---------------------------------------------------------------------------------------

def summary_sql(by: str, keep: str = "is not null") -> str:
    parts = [
        f"""select {by}, '{c}' criterion, avg({c}) mean, stddev_pop({c}) std, min({c}) as min, max({c}) as max, count({c}) n
 from (select * replace (case when {c} {keep} then {c} end as {c}) from judged) group by 1"""
        for c in CRITERIA
    ]
    return " union all ".join(parts)


_SUMMARY = "criterion:s mean:d std:d min:d max:d n:i"


@query("criterion_summary", f"video_type:s {_SUMMARY}", summary_sql("video_type"))
def _(spark, sf):
    return J.criterion_summary(fx.judged(spark, sf), ["video_type"])


@query(
    "criterion_summary_truthy", f"scene:s {_SUMMARY}",
    summary_sql("scene", "<> 0").replace("from judged)", "from (select * replace (correctness-1 as correctness) from judged))"),
)
def _(spark, sf):
    """Correctness is shifted to start at 0, which the truthiness form drops."""
    shifted = fx.judged(spark, sf).withColumn("correctness", F.col("correctness") - 1)
    return J.criterion_summary(shifted, ["scene"], drop_zero=True)


_OVERALL = {
    "criterion_means": "(avg(correctness)+avg(specificity)+avg(completeness)+avg(fluency))/4",
    "pooled": "(sum(correctness)+sum(specificity)+sum(completeness)+sum(fluency))/(count(correctness)+count(specificity)"
    "+count(completeness)+count(fluency))",
    "row_means": f"avg({_ROW})",
}


def _overall(mode: str) -> None:
    @query(f"overall_{mode}", "video_type:s overall:d", f"select video_type, {_OVERALL[mode]} overall from judged group by 1")
    def _(spark, sf):
        return J.overall(fx.judged(spark, sf), mode, ["video_type"])


for _mode in _OVERALL:
    _overall(_mode)


@query(
    "ablation_summary", "variant:s correctness:d specificity:d completeness:d fluency:d overall:d n:i",
    f"""select variant, avg(correctness) correctness, avg(specificity) specificity, avg(completeness) completeness,
 avg(fluency) fluency, avg({_ROW}) overall, count(*) n from runs group by 1""",
    runs=RUNS,
)
def _(spark, sf):
    return J.ablation_summary(runs(spark, sf), ["variant"])


_VARIANTS = ("a", "b")


@query(
    "scene_summary", "scene:s " + " ".join(f"{v}_{c}:d" for v in _VARIANTS for c in CRITERIA) + " a_n:i b_n:i",
    "select scene, " + ", ".join(f"avg({c}) filter (variant='{v}') {v}_{c}" for v in _VARIANTS for c in CRITERIA)
    + ", count(correctness) filter (variant='a') a_n, count(correctness) filter (variant='b') b_n from runs group by 1",
    runs=RUNS,
)
def _(spark, sf):
    return J.scene_summary(runs(spark, sf), _VARIANTS)


@query(
    "widen", "video_id:i " + " ".join(f"{v}_{c}:i" for v in _VARIANTS for c in CRITERIA),
    "select video_id, " + ", ".join(f"max({c}) filter (variant='{v}') {v}_{c}" for v in _VARIANTS for c in CRITERIA)
    + " from runs group by 1",
    runs=RUNS,
)
def _(spark, sf):
    return J.widen(runs(spark, sf), _VARIANTS, CRITERIA)


@query(
    "lengthen", "video_id:i variant:s " + " ".join(f"{c}:i" for c in CRITERIA),
    f"""select i.video_id, v.variant, {", ".join(f"r.{c}" for c in CRITERIA)} from (select distinct video_id from runs) i
 join (select unnest(['a','b']) variant) v on true left join runs r on r.video_id=i.video_id and r.variant=v.variant""",
    runs=RUNS,
)
def _(spark, sf):
    return J.lengthen(J.widen(runs(spark, sf), _VARIANTS, CRITERIA), _VARIANTS, CRITERIA)


# --- paired comparisons ----------------------------------------------------------------------------------------

@query(
    "run_delta", "video_id:i " + " ".join(f"d_{c}:d" for c in CRITERIA) + " d_mean:d",
    "select *, (" + "+".join(f"d_{c}" for c in CRITERIA) + ")/4.0 d_mean from (select video_id, "
    + ", ".join(f"coalesce(a.{c},0)-coalesce(b.{c},0) d_{c}" for c in CRITERIA)
    + " from judged a join judged_b b using (video_id))",
)
def _(spark, sf):
    return J.run_delta(fx.judged(spark, sf), fx.judged_b(spark, sf))


@query(
    "mean_delta", "criterion:s mean_a:d mean_b:d delta:d",
    " union all ".join(
        f"select '{c}' criterion, avg({c}) filter (variant='a') mean_a, avg({c}) filter (variant='b') mean_b,"
        f" avg({c}) filter (variant='a') - avg({c}) filter (variant='b') delta from runs" for c in CRITERIA
    ),
    runs=RUNS,
)
def _(spark, sf):
    return J.mean_delta(runs(spark, sf), "a", "b")


@query(
    "paired", "video_id:i value_a:d value_b:d",
    f"""select a.video_id, a.overall value_a, b.overall value_b from overalls a join overalls b using (video_id)
 where a.variant='a' and b.variant='b'""",
    runs=RUNS, overalls=OVERALLS,
)
def pairs(spark, sf):
    rows = overalls(spark, sf)
    return X.paired(rows.filter("variant = 'a'"), rows.filter("variant = 'b'"))


_PAIRS = (("a", "b"), ("a", "c"))
_PAIR_SQL = " union all ".join(
    f"""select '{a} vs {b}' pair, x.video_id, x.overall va, y.overall vb, x.overall-y.overall diff from overalls x join overalls y
 using (video_id) where x.variant='{a}' and y.variant='{b}'""" for a, b in _PAIRS
)


def bootstrap_sql(reps: int, lo: str, hi: str) -> dict:
    return dict(
        runs=RUNS, overalls=OVERALLS, prs=_PAIR_SQL,
        pos="""select pair, diff, row_number() over (partition by pair order by md5(concat_ws(':', '42', video_id)), video_id)-1 pos,
 count(*) over (partition by pair) n from prs""",
        deltas=f"""select d.pair, rep, avg(diff) d from (select pair, n, rep, unnest(range(n)) draw from (select distinct pair, n,
 unnest(range({reps})) rep from pos)) d join pos on pos.pair=d.pair and pos.pos = ('0x'||substr(md5('42:'||rep||':'||draw),1,8))::bigint
 % d.n group by 1, 2""",
        answer_parts=f"""select pair, {lo} ci_lo, {hi} ci_hi, avg(case when d > 0 then 1.0 else 0.0 end) p_pos from deltas group by 1""",
    )


_BOOT = """select m.*, ci_lo, ci_hi, p_pos, ci_lo > 0 or ci_hi < 0 significant from answer_parts join (select pair, count(*) n_paired,
 avg(va) mean_a, avg(vb) mean_b, avg(diff) delta from prs group by 1) m using (pair)"""
_BOOT_COLS = "n_paired:i mean_a:d mean_b:d delta:d ci_lo:d ci_hi:d p_pos:d significant:b"


@query(
    "paired_bootstrap", _BOOT_COLS, _BOOT + " where pair='a vs b'",
    **bootstrap_sql(10_000, "quantile_cont(d, 0.025)", "quantile_cont(d, 0.975)"),
)
def _(spark, sf):
    return J.paired_bootstrap(pairs(spark, sf))


@query(
    "paired_bootstrap_element", _BOOT_COLS, _BOOT + " where pair='a vs b'",
    **bootstrap_sql(10_000, "list_sort(list(d))[251]", "list_sort(list(d))[9751]"),
)
def _(spark, sf):
    return J.paired_bootstrap(pairs(spark, sf), 10_000, ci="element")


@query(
    "pairwise_significance", "pair:s " + _BOOT_COLS, _BOOT,
    **bootstrap_sql(10_000, "quantile_cont(d, 0.025)", "quantile_cont(d, 0.975)"),
)
def _(spark, sf):
    return J.pairwise_significance(overalls(spark, sf), _PAIRS, 10_000)


# --- agreement and text ----------------------------------------------------------------------------------------

SHEET = "select video_id, " + ", ".join(f"a.{c} h_{c}, b.{c} g_{c}" for c in CRITERIA) + \
    " from judged a join judged_b b using (video_id) where a.correctness is not null"


def sheet(spark, sf):
    a = fx.judged(spark, sf).filter("correctness is not null").select("video_id", *[F.col(c).alias(f"h_{c}") for c in CRITERIA])
    b = fx.judged_b(spark, sf).select("video_id", *[F.col(c).alias(f"g_{c}") for c in CRITERIA])
    return a.join(b, "video_id")


_AGREEMENT_COLS = "criterion:s n:i mean_x:d mean_y:d pearson:d spearman:d mae:d"
_AGREEMENT = """select criterion, count(*) n, avg(x) mean_x, avg(y) mean_y, case when stddev_pop(x)>0 and stddev_pop(y)>0 then corr(x, y) end pearson,
 case when stddev_pop(x)>0 and stddev_pop(y)>0 then corr(rx, ry) end spearman, avg(abs(x-y)) mae from (select *,
 rank() over (partition by criterion order by x) + (count(*) over (partition by criterion, x)-1)/2.0 rx,
 rank() over (partition by criterion order by y) + (count(*) over (partition by criterion, y)-1)/2.0 ry from rated where x is not null and y is not null)
 group by 1 having count(*) >= 5"""


@query(
    "agreement", _AGREEMENT_COLS, _AGREEMENT,
    sheet=SHEET,
    rated=" union all ".join(f"select '{c}' criterion, h_{c}::double x, g_{c}::double y from sheet" for c in CRITERIA)
    + " union all select 'overall', (" + "+".join(f"h_{c}" for c in CRITERIA) + ")/4.0, (" + "+".join(f"g_{c}" for c in CRITERIA)
    + ")/4.0 from sheet",
)
def _(spark, sf):
    rows = sheet(spark, sf).withColumns({
        "h_all": J.row_overall([f"h_{c}" for c in CRITERIA]), "g_all": J.row_overall([f"g_{c}" for c in CRITERIA]),
    })
    columns = {c: (f"h_{c}", f"g_{c}") for c in CRITERIA}
    return J.agreement(rows, {**columns, "overall": ("h_all", "g_all")})


_SHORT = dict(zip(CRITERIA, RATINGS))  # the short names in the heads of a rating sheet


@query(
    "read_rating_sheet", _AGREEMENT_COLS, _AGREEMENT,
    sheet=SHEET + " and a.fluency is not null",
    rated=" union all ".join(f"select '{_SHORT[c]}' criterion, h_{c}::double x, g_{c}::double y from sheet" for c in CRITERIA),
)
def _(spark, sf):
    """The two runs as a rating sheet in a CSV file; rows with an empty human cell do not count."""
    path = f"{shared_folder(spark).rstrip('/')}/scorewise/{spark.sparkContext.applicationId}/ratings-{uuid.uuid4().hex}"
    judge = ("GPT_C_HIDE_until_done", "GPT_S_HIDE", "GPT_Co_HIDE", "GPT_F_HIDE")  # fixed header names
    people = [F.col(f"h_{c}").alias(f"human_{_SHORT[c]} (1-5)") for c in CRITERIA]
    sheet(spark, sf).select("video_id", *people, *[F.col(f"g_{c}").alias(j) for c, j in zip(CRITERIA, judge)]).write.csv(path, header=True)
    return J.agreement(readers.read_rating_sheet(spark, path), {s: (f"h_{s}", f"g_{s}") for s in RATINGS})


_BASES = (0.0, 1e8)


@query(
    "agreement_far_from_zero", _AGREEMENT_COLS, _AGREEMENT,
    rated=" union all ".join(f"select '{b}' criterion, score*100+{b} x, label*10+score*30+{b} y from numbered" for b in _BASES),
)
def _(spark, sf):
    """Values of about one size far from zero, where sums of squares cancel."""
    score, label = F.col("score") * 100, F.col("label") * 10 + F.col("score") * 30
    moved = {f"{s}{i}": c + b for i, b in enumerate(_BASES) for s, c in (("x", score), ("y", label))}
    rows = fx.labelled_scores(spark, sf).select(*[c.alias(n) for n, c in moved.items()])
    return J.agreement(rows, {str(b): (f"x{i}", f"y{i}") for i, b in enumerate(_BASES)})


@query(
    "word_stats", "lang:s mean_words:d min_words:i max_words:i",
    r"""select lang, avg(w) mean_words, min(w) min_words, max(w) max_words from (select lang,
 len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) w from documents) group by 1""",
)
def _(spark, sf):
    return J.word_stats(fx.table(spark, sf, "documents"), "text", ["lang"])


@query(
    "valid_text", "video_id:i", "select video_id from judged where text <> '' and not starts_with(text, 'ERROR')",
)
def _(spark, sf):
    return fx.judged(spark, sf).filter(valid_text(F.col("text"))).select("video_id")


# --- joins between runs ----------------------------------------------------------------------------------------

@query(
    "attach_reference", "video_id:i video_type:s reference:s",
    """select j.video_id, case when hit then 'anomalous' else 'normal_FP' end video_type,
 case when hit then r.explanation else 'Nothing anomalous happens.' end reference from (select j.*, r.explanation,
 j.video_type='anomalous' and r.explanation is not null hit from judged j left join refs r using (video_id)) j
 left join refs r using (video_id)""",
    refs="select doc_id video_id, lang || ' ' || source explanation from documents where doc_id%4<>0",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").filter("doc_id % 4 <> 0")
    refs = docs.select(F.col("doc_id").alias("video_id"), F.concat_ws(" ", "lang", "source").alias("explanation"))
    return X.attach_reference(fx.judged(spark, sf), refs, "Nothing anomalous happens.")


@query(
    "pending", "video_id:i", "select video_id from judged where video_id not in (select video_id from judged_b)",
)
def _(spark, sf):
    return X.pending(fx.judged(spark, sf).select("video_id"), fx.judged_b(spark, sf))


@query(
    "resume", "video_id:i correctness:i",
    """select video_id, correctness from judged_b union all select video_id, 0 from judged
 where video_id not in (select video_id from judged_b)""",
)
def _(spark, sf):
    done = fx.judged_b(spark, sf).select("video_id", "correctness")
    todo = fx.judged(spark, sf).select("video_id")
    return X.resume(todo, done, lambda df: df.withColumn("correctness", F.lit(0)))


@query(
    "lookup", "video_id:i fluency:i", "select a.video_id, b.fluency from judged a left join judged_b b using (video_id)",
)
def _(spark, sf):
    return X.lookup(fx.judged(spark, sf).select("video_id"), fx.judged_b(spark, sf), "fluency")


@query(
    "flips", "video_id:i baseline:b current:b direction:s",
    """select video_id, a.correctness>=3 baseline, b.correctness>=3 as current,
 case when b.correctness>=3 then 'MISSED->DETECTED' else 'DETECTED->MISSED' end direction
 from judged a join judged_b b using (video_id) where (a.correctness>=3) is distinct from (b.correctness>=3)""",
)
def _(spark, sf):
    hit = (F.col("correctness") >= 3).alias("detected")
    a, b = fx.judged(spark, sf).select("video_id", hit), fx.judged_b(spark, sf).select("video_id", hit)
    return X.flips(a, b, ["video_id"])


@query(
    "check_references", "video_id:i",
    "select distinct video_id from judged where video_id not in (select doc_id from documents where doc_id%6<>0)",
)
def _(spark, sf):
    from scorewise.sources.readers import missing_references

    docs = fx.table(spark, sf, "documents").filter("doc_id % 6 <> 0").select(F.col("doc_id").alias("video_id"))
    return missing_references(fx.judged(spark, sf), docs, "video_id")


# --- id sets ---------------------------------------------------------------------------------------------------

@query("common_ids", "video_id:i", "select video_id from judged intersect select video_id from judged_b")
def _(spark, sf):
    return X.common_ids(fx.judged(spark, sf), fx.judged_b(spark, sf))


@query("except_ids", "video_id:i", "select doc_id video_id from documents except select video_id from judged_b")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"))
    return X.except_ids(docs, fx.judged_b(spark, sf))


@query("all_ids", "video_id:i", "select video_id from judged_b union select doc_id from documents where doc_id%2=0")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("video_id"))
    return X.all_ids(fx.judged_b(spark, sf), docs)


@query(
    "union_rows", "video_id:i strategy:s fluency:i",
    "select video_id, 'judged' strategy, fluency from judged_b union all select doc_id, 'plain', null from documents",
)
def _(spark, sf):
    a = fx.judged_b(spark, sf).select("video_id", "fluency", F.lit("judged").alias("strategy"))
    b = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.lit("plain").alias("strategy"))
    return X.union_rows(a, b)


# --- ids -------------------------------------------------------------------------------------------------------
# every customer becomes a recording id: scene = nation, clip = key padded to three or four digits

_IDS = """select lpad(cast(c_nationkey as varchar), 2, '0') || '_' || case when c_custkey%3=0
 then lpad(cast(c_custkey as varchar), 4, '0') else lpad(cast(c_custkey%1000 as varchar), 3, '0') end video_id, c_custkey from customer"""


def clip_ids(spark, sf):
    key = F.col("c_custkey").cast("string")
    short = F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")
    clip = F.when(F.col("c_custkey") % 3 == 0, F.lpad(key, 4, "0")).otherwise(short)
    scene = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    return fx.table(spark, sf, "customer").select(F.concat_ws("_", scene, clip).alias("video_id"), "c_custkey")


@query("scene_id", "c_custkey:i scene:s", "select c_custkey, split_part(video_id, '_', 1) scene from clips", clips=_IDS)
def _(spark, sf):
    return clip_ids(spark, sf).select("c_custkey", ids.scene_id(F.col("video_id")).alias("scene"))


@query(
    "video_type", "c_custkey:i video_type:s video_type_annotated:s",
    """select c_custkey, case when len(split_part(video_id,'_',2))=4 then 'anomalous' else 'normal_FP' end video_type,
 case when len(split_part(video_id,'_',2))=4 and c_custkey%2=0 then 'anomalous' else 'normal_FP' end video_type_annotated from clips""",
    clips=_IDS,
)
def _(spark, sf):
    name = F.col("video_id")
    annotated = ids.video_type(name, F.col("c_custkey") % 2 == 0)
    return clip_ids(spark, sf).select(
        "c_custkey", ids.video_type(name).alias("video_type"), annotated.alias("video_type_annotated")
    )


@query(
    "is_anomalous_clip", "video_id:s c_custkey:i",
    r"select * from clips where regexp_full_match(video_id, '[0-9]{2}_[0-9]{4}')", clips=_IDS,
)
def _(spark, sf):
    return clip_ids(spark, sf).filter(ids.is_anomalous_clip(F.col("video_id")))


@query("select_video", "video_id:s", "select video_id from clips where contains(video_id, '1_01')", clips=_IDS)
def _(spark, sf):
    return clip_ids(spark, sf).filter(F.contains("video_id", F.lit("1_01"))).select("video_id")


@query(
    "feature_id", "c_custkey:i video_id:s", "select c_custkey, video_id from clips", clips=_IDS,
)
def _(spark, sf):
    path = F.concat(F.lit(" /data/features/"), F.col("video_id"), F.lit("_i3d.npy "))
    return clip_ids(spark, sf).select("c_custkey", ids.feature_id(path).alias("video_id"))


@query(
    "resolve_ids", "video_id:s target:s",
    """select video_id, arg_min(target, p) target from (select n.video_id, t.target, case
 when t.target = n.video_id then 0 when lower(t.target) = lower(n.video_id) then 1
 when lower(t.target) = lower(n.padded) then 2 when lower(t.target) = lower(n.stripped) then 3 end p
 from names n left join targets t on lower(t.target) in (lower(n.video_id), lower(n.padded), lower(n.stripped)))
 group by video_id""",
    clips=_IDS,
    names="""select video_id, split_part(video_id,'_',1)||'_'||lpad(split_part(video_id,'_',2),4,'0') padded,
 split_part(video_id,'_',1)||'_'||case when ltrim(split_part(video_id,'_',2),'0')='' then '0' else ltrim(split_part(video_id,'_',2),'0') end stripped
 from (select distinct 'S'||video_id video_id from clips)""",
    targets="""select distinct case when c_custkey%5=0 then 's'||video_id when c_custkey%5=1 then 'S'||lpad(cast(c_nationkey as varchar),2,'0')||
 '_'||lpad(cast(c_custkey%1000 as varchar),4,'0') when c_custkey%5=2 then 'S'||lpad(cast(c_nationkey as varchar),2,'0')||'_'||
 cast(c_custkey%1000 as varchar) else 'S'||video_id end target from clips join customer using (c_custkey) where c_custkey%7<>0""",
)
def _(spark, sf):
    clips = clip_ids(spark, sf).join(fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    names = clips.select(F.concat(F.lit("S"), "video_id").alias("video_id"))
    scene = F.concat(F.lit("S"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("_"))
    small, kind = (F.col("c_custkey") % 1000).cast("string"), F.col("c_custkey") % 5
    target = (
        F.when(kind == 0, F.concat(F.lit("s"), "video_id")).when(kind == 1, F.concat(scene, F.lpad(small, 4, "0")))
        .when(kind == 2, F.concat(scene, small)).otherwise(F.concat(F.lit("S"), "video_id"))
    )
    return X.resolve_ids(names, clips.filter("c_custkey % 7 <> 0").select(target.alias("video_id")).distinct())
