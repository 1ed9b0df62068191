"""Small hand-made cases."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewise.functions import arrays, frames, ids, text
from scorewise.operators import chat as C
from scorewise.operators import intervals as I
from scorewise.operators import judged as J
from scorewise.operators import matching as X
from scorewise.operators import metrics as M
from scorewise.operators import sampling as P
from scorewise.operators import scoring, splits
from scorewise.operators import series as S
from scorewise.operators import vectors as V


def series(spark, *lists):
    rows = [(k, i, None if s is None else float(s)) for k, x in enumerate(lists) for i, s in enumerate(x)]
    return spark.createDataFrame(rows, "series_id long, idx long, score double")


def spans(df):
    return sorted((r.series_id, r.seg_no, r.start_idx, r.end_idx) for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_open_run(spark):
    df = series(spark, [0.1, 0.5, 0.6])
    assert spans(S.threshold_runs(df, 0.3)) == [(0, 0, 1, 2)]
    assert spans(S.hysteresis_segments(df, 0.4, 0.3, 1)) == [(0, 0, 1, 3)]


def test_between_scores_keep_the_state(spark):
    df = series(spark, [0.6, 0.4, 0.4, 0.2])
    assert spans(S.hysteresis_segments(df, 0.5, 0.3, 1)) == [(0, 0, 0, 3)]
    assert spans(S.hysteresis_segments(df, 0.5, 0.3, 8)) == []
    with pytest.raises(ValueError):
        S.hysteresis_segments(df, 0.3, 0.5)


def test_nan_keeps_the_state(spark):
    df = series(spark, [0.6, math.nan, 0.6], [math.nan, 0.6, math.nan], [None, 0.6, None, 0.1])
    assert spans(S.threshold_runs(df, 0.5)) == [(0, 0, 0, 2), (1, 0, 1, 2), (2, 0, 1, 2)]


def test_no_segment_scores_zero(spark):
    df = series(spark, [0.1, 0.2])
    summary = S.segment_summary(df, S.hysteresis_segments(df), "exclusive")
    assert S.segment_mean_max(df.select("series_id").distinct(), summary).first().segment_mean_max == 0


def test_constant_series(spark):
    df = series(spark, [0.4, 0.4, 0.4])
    assert {r.score for r in S.minmax(df).collect()} == {0.4}
    assert {r.score for r in S.minmax(df, "zero").collect()} == {0.0}
    assert {r.score for r in S.minmax(df, "eps").collect()} == {0.0}


def test_odd_kernel_is_rejected(spark):
    with pytest.raises(ValueError):
        S.gaussian_smooth(series(spark, [0.1]), 9, 2)


def test_budgets(spark):
    x = [0.9] + [0.0] + [0.5 + i / 100 for i in range(15)]
    df = series(spark, x)
    got = P.budget_sample(df, S.threshold_runs(df, 0.1))
    assert {r.seg_no: r["count"] for r in got.groupBy("seg_no").count().collect()} == {0: 1, 1: 8}
    df = series(spark, ([0.9, 0.8, 0.9, 0.0] * 5)[:-1])
    assert P.budget_sample(df, S.threshold_runs(df, 0.1)).count() == 10


def test_uniform(spark):
    n = F.lit(8)
    assert value(spark, arrays.uniform_trunc(n, 5)) == [0, 1, 3, 5, 7]
    assert value(spark, arrays.uniform_round(n, 5)) == [0, 2, 4, 5, 7]
    assert value(spark, arrays.uniform_round(n, 1, "middle")) == [4]
    assert value(spark, arrays.uniform_trunc(F.lit(3), 5)) == [0, 1, 2]
    assert value(spark, arrays.uniform_trunc(F.lit(0), 5)) == []
    assert value(spark, arrays.uniform_interior(F.lit(35), F.lit(190), 3)) == [73, 112, 151]
    assert value(spark, arrays.uniform_interior(F.lit(4), F.lit(6), 3)) == [4, 5]


def brute_nearest(a0, a1, n_frames, n_snip):
    lo = [i * n_frames // n_snip for i in range(n_snip)]
    hi = [max(l, min(n_frames - 1, (i + 1) * n_frames // n_snip - 1)) for i, l in enumerate(lo)]
    hit = [i for i in range(n_snip) if not (hi[i] < a0 or lo[i] > a1)]
    centre = (a0 + a1) // 2
    away = [max(lo[i] - centre, centre - hi[i], 0) for i in range(n_snip)]
    return (hit[0], hit[-1]) if hit else (None, None), away.index(min(away))


def test_windows_on_any_grid(spark):
    grids = [(10, 10), (100, 7), (7, 100), (160, 10), (5, 1), (1, 5), (333, 21), (50, 49)]
    asks = [(0, 0), (0, 500), (3, 4), (40, 60), (99, 99), (500, 700), (6, 6), (149, 160)]
    cases = [(k, a, b, f, t) for k, ((f, t), (a, b)) in enumerate((g, s) for g in grids for s in asks)]
    ann = spark.createDataFrame([c[:3] for c in cases], "series_id long, start_frame long, end_frame long")
    grid = spark.createDataFrame([(c[0], c[3], c[4]) for c in cases], "series_id long, n_frames long, n_snip long")
    overlap = {r.series_id: (r.start_idx, r.end_idx) for r in I.overlap_windows(ann, grid).collect()}
    near = {r.series_id: r.idx for r in I.nearest_snippet(ann, grid).collect()}
    for k, a, b, f, t in cases:
        assert (overlap[k], near[k]) == brute_nearest(a, b, f, t), (a, b, f, t)


def test_snippet_frames(spark):
    assert value(spark, frames.snippet_mid_frame(F.lit(3), F.lit(100), F.lit(7))) == 42 + 7
    assert value(spark, frames.topk_frame(F.lit(31), F.lit(100), F.lit(10))) == 99
    assert value(spark, frames.frame_to_snippet(F.lit(99), F.lit(100), F.lit(7))) == 6


def test_pool_short_series(spark):
    df = spark.createDataFrame([(1, i, [float(i)]) for i in range(3)], "series_id long, idx long, vec array<double>")
    got = {r.bucket: r.vec[0] for r in V.temporal_pool(df).collect()}
    assert got == {b: float(b * 3 // 32) for b in range(32)}


def test_embeddings_without_frames(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "series_id long, vec array<double>")
    got = {r.series_id: r.vec for r in V.mean_pool_embeddings(df, dim=2).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_signature(spark):
    df = series(spark, [0.5], [0.0, 0.0])
    ids_ = spark.createDataFrame([(0,), (1,), (7,)], "series_id long")
    got = {r.series_id: r.vec for r in V.score_signature(df, 4, ids_).collect()}
    assert got[0] == pytest.approx([0.5] * 4) and got[1] == [0.0] * 4 and got[7] == [0.0] * 4


def test_retrieval_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    index, asked = unit(rng.normal(size=(300, 8))), unit(rng.normal(size=(40, 8)))
    index[7] = index[250]  # an exact tie
    i = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(index)], "index_id long, vec array<double>").repartition(7)
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)] + [(99, [0.0] * 8)], "query_id long, vec array<double>")
    got = {}
    for r in V.topk_similar(q, i, 5, block=16, parts=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.index_id, r.sim))
    for k, v in enumerate(asked):
        sims = index @ v
        want = sorted(range(300), key=lambda j: (-round(sims[j], 12), j))[:5]
        assert [j for j, _ in got[k]] == want
    assert got[99] == [(j, None) for j in range(5)]


def test_retrieval_skips_what_cannot_be_near(spark):
    """On clustered vectors most pairs are never compared, and the result is that of comparing all."""
    import numpy as np

    rng = np.random.default_rng(1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    heart = unit(rng.normal(size=(20, 16)))
    near = lambda n: unit(heart[rng.integers(0, 20, n)] + 0.05 * rng.normal(size=(n, 16)))
    index, asked = near(4000), near(200)
    index[11], index[12], index[13] = 0, index[13], 3 * index[13]  # no direction, a tie, and a longer one
    i = spark.createDataFrame([(k, v.tolist(), "a" if k % 2 else "b") for k, v in enumerate(index)], "index_id long, vec array<double>, g string")
    q = spark.createDataFrame([(k, v.tolist(), "a" if k % 3 else "b") for k, v in enumerate(asked)], "query_id long, vec array<double>, g string")
    for group in (None, "g"):
        local = V.local_topk(q, i, 3, group, block=64, parts=4).cache()
        got = {}
        for r in V.topk_similar(q, i, 3, group, block=64, parts=4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.index_id)
        for k, v in enumerate(asked):
            mine = [j for j in range(4000) if group is None or (j % 2 > 0) == (k % 3 > 0)]
            sims = (index[mine] * v).sum(axis=1)
            assert got[k] == [mine[j] for j in sorted(range(len(mine)), key=lambda j: (-round(sims[j], 12), j))[:3]]
        # one row per query and strip says how many vectors of the strip it was compared with
        compared = local.select("query_id", "compared", F.pmod(F.xxhash64("index_id"), F.lit(2)).alias("strip")).distinct()
        assert compared.agg(F.sum("compared")).first()[0] < 0.3 * 200 * 4000
        local.unpersist()
        every = V.local_topk(q, i, 3, group, block=64, parts=4, centers=0)
        assert V._ranked(every, [], 3).count() >= 600


def test_retrieval_tells_apart_what_single_precision_does_not(spark):
    """Of 60 vectors that differ in the ninth digit and 200 copies, each query gets the best, ties by id."""
    import numpy as np

    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    base = unit(rng.normal(size=16))
    index = unit(np.concatenate([base + 1e-5 * rng.normal(size=(60, 16)), np.tile(unit(rng.normal(size=16)), (200, 1)), rng.normal(size=(200, 16))]))
    i = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(index)], "index_id long, vec array<double>")
    q = spark.createDataFrame([(0, base.tolist()), (1, index[100].tolist())], "query_id long, vec array<double>")
    got = {}
    for r in V.topk_similar(q, i, 5, parts=1, centers=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.index_id)
    assert got[0] == np.argsort(-np.einsum("d,id->i", base, index), kind="stable")[:5].tolist() and got[1] == [60, 61, 62, 63, 64]


def test_touching_intervals_have_no_iou(spark):
    ann = spark.createDataFrame([(1, 0, 10), (2, 0, 10)], "series_id long, start_frame long, end_frame long")
    seg = spark.createDataFrame([(1, 0, 10, 20), (2, 0, 5, 10), (2, 1, 0, 10)], "series_id long, seg_no long, start_frame long, end_frame long")
    got = {r.series_id: r.temporal_iou for r in I.temporal_iou(ann, seg).collect()}
    assert got == {1: 0.0, 2: 0.5}


def test_auc_ties(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1)], "score double, label int")
    assert M.roc_auc(df).first().auc == 0.5


def test_published_gate_counts(spark):
    rows = [(1, 1)] * 40 + [(0, 0)] * 149 + [(0, 1)] * 6 + [(1, 0)] * 4
    got = M.confusion_metrics(spark.createDataFrame(rows, "label int, prediction int")).first()
    assert (got.accuracy, got.f1) == (pytest.approx(0.949749, abs=1e-6), pytest.approx(0.888889, abs=1e-6))


def test_confusion_of_nothing(spark):
    got = M.confusion_metrics(spark.createDataFrame([], "label int, prediction int")).first()
    assert (got.accuracy, got.precision, got.recall, got.f1, got.balanced_accuracy) == (0, 0, 0, 0, 0)


def test_sweep_of_equal_scores(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1)], "score double, label int")
    got = M.threshold_sweep(df).collect()
    assert [(r.threshold, r.tp, r.fp) for r in got] == [(0.5, 1, 1)]


def test_calibration_needs_both_overrides(spark):
    df = series(spark, [0.1])
    with pytest.raises(ValueError):
        M.apply_calibration(df, df, k=3)
    with pytest.raises(ValueError):
        M.apply_calibration(df, df)
    labels = spark.createDataFrame([(0, 1)], "series_id long, label int")
    assert M.apply_calibration(df, labels, k=3, threshold=0.1).first().prediction == 1


def test_balanced_sample_refuses_a_short_class(spark):
    df = spark.createDataFrame([(i, int(i < 2)) for i in range(10)], "series_id long, label int")
    assert P.balanced_sample(df, 2, 3).count() == 5
    with pytest.raises(Exception, match="fewer than"):
        P.balanced_sample(df, 3, 3).collect()


def test_aligned_profile_only(spark):
    assert S.position_profile(series(spark, [0.1, 0.3], [0.3, 0.5])).count() == 2
    assert S.position_profile(series(spark, [0.1, 0.3], [0.3])).count() == 0


def test_overall_forms_differ_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (3, 4, 4)], "a int, b int, c int")
    get = lambda mode: J.overall(df, mode, criteria=["a", "b", "c"]).first().overall
    assert get("criterion_means") == pytest.approx((2 + 4 + 4.5) / 3)
    assert get("pooled") == pytest.approx(17 / 5)
    assert get("row_means") == pytest.approx(11 / 3)


def test_bootstrap(spark):
    rows = [(i, 3.0 + i % 3, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "video_id long, value_a double, value_b double")
    got = J.paired_bootstrap(df, 500).first()
    assert got.n_paired == 30 and got.delta == pytest.approx(2.0) and got.p_pos == 1.0 and got.significant
    assert got.ci_lo < 2.0 < got.ci_hi
    again = J.paired_bootstrap(df.repartition(9), 500, chunk=7).first()
    assert (again.ci_lo, again.ci_hi) == pytest.approx((got.ci_lo, got.ci_hi))


@pytest.mark.parametrize("prefix", ["", "42:7:", "42:123456:", "x" * 50, "y" * 60])
def test_digests_of_numbers(prefix):
    from hashlib import md5

    from scorewise.functions.digests import md5_heads

    for n in (1, 7, 10, 1234, 25_001):
        want = [int.from_bytes(md5(f"{prefix}{i}".encode()).digest()[:4], "big") for i in range(n)]
        assert [int(x) for heads in md5_heads(prefix, n) for x in heads] == want


def test_bootstrap_draws_once_for_all_blocks(monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(J, "md5_heads", lambda prefix, n: made.append(prefix) or iter([np.arange(n, dtype=np.uint32)]))
    rows = [{"pair": "p", "blk": b, "n": 20, "diffs": [1.0, None, 2.0, 4.0, 0.5], "step": 2, "rep": 0} for b in range(4)]
    out = list(J._drawn_sums(["pair"], 2, 42, 5)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert made == ["42:0:", "42:1:"]
    assert [tuple(r.values()) for batch in out for r in batch.to_pylist()] == [("p", 0, 30.0, 16), ("p", 1, 30.0, 16)]
    made.clear()
    out = list(J._drawn_sums(["pair"], 2, 42, 5, held=10)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(made) == 4 and sum(batch.column("s")[0].as_py() for batch in out) == 30.0


def test_agreement_needs_five_rows(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(4)], "a int, b int")
    assert J.agreement(df, {"x": ("a", "b")}).count() == 0
    df = spark.createDataFrame([(i, i * i) for i in range(9)], "a int, b int")
    got = J.agreement(df, {"x": ("a", "b")}, ranges=20).first()
    assert got.spearman == pytest.approx(1.0) and got.pearson < 1


def test_flips_with_undecided(spark):
    a = spark.createDataFrame([(1, None), (2, True), (3, False)], "id long, detected boolean")
    b = spark.createDataFrame([(1, True), (2, None), (3, False)], "id long, detected boolean")
    got = {r.id: r.direction for r in X.flips(a, b, ["id"]).collect()}
    assert got == {1: "MISSED->DETECTED", 2: "DETECTED->MISSED"}


def test_ids(spark):
    df = spark.createDataFrame([("01_0027",), ("01_027",), ("x",), ("01_00271",)], "v string")
    got = [tuple(r) for r in df.select(
        ids.scene_id(F.col("v")), ids.video_type(F.col("v")), ids.is_anomalous_clip(F.col("v")),
        ids.zero_padded(F.col("v")), ids.zero_stripped(F.col("v")),
    ).collect()]
    assert got == [
        ("01", "anomalous", True, "01_0027", "01_27"), ("01", "normal_FP", False, "01_0027", "01_27"),
        ("x", "normal_FP", False, None, None), ("01", "normal_FP", False, "01_00271", "01_271"),
    ]


def test_id_resolution_order(spark):
    names = spark.createDataFrame([("A_074",), ("b_0007",), ("C_1",), ("d",)], "video_id string")
    targets = spark.createDataFrame([("a_0074",), ("a_074",), ("b_7",), ("c_0001",)], "video_id string")
    got = {r.video_id: r.target for r in X.resolve_ids(names, targets).collect()}
    assert got == {"A_074": "a_074", "b_0007": "b_7", "C_1": "c_0001", "d": None}


def test_replies(spark):
    cases = {
        '```json\n{"explanation": "a b"}\n```': "a b", '{"explanation": "x"}': "x", " plain \n": "plain",
        "```\nno json\n```": "```\nno json\n```", '{"other": 1}': '{"other": 1}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.e for r in df.select("raw", text.parse_reply(F.col("raw")).alias("e")).collect()}
    assert got == cases
    df = spark.createDataFrame([("ERROR: 530",), ("",), (None,), ("fine",)], "t string")
    assert [r.t for r in df.filter(text.valid_text(F.col("t"))).collect()] == ["fine"]


def test_judgements(spark):
    replies = ['{"correctness": 4, "specificity": 1, "completeness": 5, "fluency": 6, "justification": "ok"}', "boom", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [tuple(r.j) for r in df.select("i", text.parse_judgement(F.col("r")).alias("j")).orderBy("i").collect()]
    assert got == [(4, 1, 5, None, "ok"), (None,) * 4 + ("ERROR: boom",), (None,) * 4 + ("ERROR: no reply",)]


def test_prompt_lists_every_segment(spark):
    segments = F.array(*[F.struct(F.lit(a).alias("start_snippet"), F.lit(b).alias("end_snippet")) for a, b in ((3, 7), (9, 9))])
    picks = F.array(F.struct(F.lit(3).alias("idx"), F.lit(0.81234).alias("score")))
    prompt = value(spark, C.video_prompt(F.lit(20), segments, F.lit(0.5), picks))
    assert "[snippets 3-7, snippets 9-9]" in prompt and "[snippet 3=0.812]" in prompt
    assert "[unknown]" in value(spark, C.video_prompt(F.lit(20), F.array().cast("array<struct<start_snippet:int,end_snippet:int>>"), F.lit(0.5), picks))


def test_messages_refuse_uneven_rows(spark):
    schema = "id string, video_id string, system string, conversations array<struct<`from`:string,value:string>>, images array<string>, scores array<double>"
    df = spark.createDataFrame([("a", "a", "s", [("human", "x"), ("assistant", "{}")], ["1", "2"], [0.5])], schema)
    with pytest.raises(Exception, match="differ in length"):
        C.to_messages(df).collect()


def test_relabel_and_report(spark):
    schema = "video_id string, conversations array<struct<`from`:string,value:string>>"
    df = spark.createDataFrame([("a", [("human", "q"), ("assistant", "old")]), ("b", [("assistant", "old")])], schema)
    labels = spark.createDataFrame([("a", 'say "hi"')], "video_id string, explanation string")
    turns = X.relabel(df, labels).first().conversations
    assert turns[0].value == "q" and json.loads(turns[1].value) == {"explanation": 'say "hi"'}
    assert [r.video_id for r in X.unlabelled(df, labels).collect()] == ["b"]


def test_splits_do_not_leak(spark):
    rows = [(f"v{i % 40}", "anomalous" if i % 40 < 10 else "normal", i) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id string, video_type string, n int")
    split = splits.group_split(df, 0.15, by=["video_type"])
    assert splits.leaked_ids(split).count() == 0
    report = {(r.split, r.video_type): r.n_videos for r in splits.split_report(split, ["video_type"]).collect()}
    assert report == {("eval", "anomalous"): 2, ("train", "anomalous"): 8, ("eval", "normal"): 4, ("train", "normal"): 26}
    single = splits.group_split(df.filter("video_id = 'v1'"), 0.15)
    assert {r.split for r in single.collect()} == {"eval"}


def test_resume(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "video_id string")
    done = spark.createDataFrame([("a", "old")], "video_id string, r string")
    run = lambda df: df.withColumn("r", F.lit("new"))
    assert sorted(map(tuple, X.resume(todo, done, run).collect())) == [("a", "old"), ("b", "new")]
    assert sorted(map(tuple, X.resume(todo, done, run, force=True).collect())) == [("a", "new"), ("b", "new")]


def test_model_failures_keep_their_rows(spark):
    def load():
        def model(rows):
            if (rows["x"] == 3).any():
                raise RuntimeError("bad row")
            return pd.DataFrame({"y": rows["x"] * 2.0, "say": "ok"})
        return model

    df = spark.range(10).select(F.col("id").alias("x"))
    got = {r.x: (r.y, r.say) for r in scoring.score_batches(df, load, "y DOUBLE, say STRING", 4).collect()}
    assert len(got) == 10 and got[3] == (None, "ERROR: bad row") and got[4] == (8.0, "ok")


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        P.run_strategies(series(spark, [0.1]), ["nope"])


def test_top_regions(spark):
    rows = [(1, r, float(v)) for r, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])] + [(2, 0, 5.0)] + [(3, r, 1.0) for r in range(9)]
    df = spark.createDataFrame(rows, "frame long, region long, value double")
    got = {}
    for r in P.top_regions(df).collect():
        got.setdefault(r.frame, set()).add(r.region)
    assert got == {1: {6, 7}, 2: {0}, 3: {0, 1, 2, 3, 4}}
