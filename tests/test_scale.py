"""What must hold at any size: one answer on both sides of a plan's switch, hot keys spread, strict replies."""

import math
import time

import pytest
from pyspark.sql import functions as F

from scorewise.functions import text
from scorewise.operators import blocks as B
from scorewise.operators import judged as J
from scorewise.operators import metrics as M
from scorewise.operators import sampling as P
from scorewise.operators import series as S
from scorewise.operators import splits
from scorewise.operators import vectors as V


def long_series(spark, n=3000):
    score = F.when(F.col("id") == 5, float("nan")).when(F.col("id") == 7, None).otherwise(F.rand(3))
    return spark.range(n).select(F.lit(1).alias("series_id"), F.col("id").alias("idx"), score.alias("score"))


def test_top_k_is_one_answer_at_every_k(spark):
    df = long_series(spark).filter("idx <> 5")
    for k in (1000, 1001):
        best = [r.idx for r in B.top_rows(df, B.KEY, k).orderBy("_rn").limit(3).collect()]
        assert best == [r.idx for r in df.orderBy(F.desc_nulls_last("score"), "idx").limit(3).collect()]
    both = [S.topk_mean(long_series(spark), k).first().topk_mean for k in (10, 1000, 1001)]
    assert all(math.isnan(x) for x in both)
    assert B.top_rows(long_series(spark), B.KEY, 1001).filter("_rn = 1").first().idx == 5


@pytest.mark.parametrize("k", [3, 1000, 2000])
def test_stored_parameters_rank_like_given_ones(spark, k):
    df, labels = long_series(spark), spark.createDataFrame([(1, 1)], "series_id int, label int")
    report = spark.createDataFrame([(k, 0.5)], "k int, threshold double")
    stored, given = M.apply_calibration(df, labels, report).collect(), M.apply_calibration(df, labels, k=k, threshold=0.5).collect()
    assert [str(r) for r in stored] == [str(r) for r in given] and len(stored) == 1
    with pytest.raises(Exception, match="(?i)scalar|more than one row"):
        M.apply_calibration(df, labels, report.union(report)).collect()


def test_smoothing_has_one_rule_for_nulls_and_gaps(spark):
    df = spark.range(200).filter("id <> 60").select(
        F.lit(1).alias("series_id"), F.col("id").alias("idx"), F.when(F.col("id") != 100, 1.0).alias("score")
    )
    for range_ in (64, 66):
        got = {r.idx: r.score for r in S.gaussian_smooth(df, range_, 4).collect()}
        assert all(v is not None and not math.isnan(v) for v in got.values())
        assert got[59] == pytest.approx(got[61], abs=0.2) and got[59] < 0.95 and got[30] == pytest.approx(1, abs=1e-3)


def test_tied_rows_of_one_key_are_spread(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.lit(0.5).alias("score"), "id")
    cut = B.ranged(df, ["k"], ["score", "id"], 20)
    sizes = [r["count"] for r in cut.groupBy("blk").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 40_000
    numbered = B.number_by_range(df, ["k"], ["score", "id"], ranges=20)
    assert numbered.filter("idx <> id").isEmpty()


def test_disjoint_spans_cost_no_more_when_they_are_many(spark):
    rows = spark.range(65_536).select(F.lit(1).alias("series_id"), F.col("id").alias("idx"), (F.col("id") % 7).cast("double").alias("score"))

    def seconds(n):
        width = 65_536 // n
        spans = spark.range(n).select(
            F.lit(1).alias("series_id"), F.col("id").alias("seg_no"), (F.col("id") * width).alias("start_idx"), (F.col("id") * width + width - 1).alias("end_idx")
        )
        taken = []
        for _ in range(3):
            begun = time.time()
            assert S.segment_summary(rows, spans).agg(F.sum("length")).first()[0] == 65_536
            taken.append(time.time() - begun)
        return min(taken)

    few, many = seconds(256), seconds(32_768)
    assert many < 1.5 * few + 1.0


def test_overlapping_segments_are_refused(spark):
    rows = long_series(spark, 20)
    spans = spark.createDataFrame([(1, 0, 2, 9), (1, 1, 9, 12)], "series_id int, seg_no int, start_idx long, end_idx long")
    with pytest.raises(Exception, match="overlap"):
        S.segment_summary(rows, spans).collect()


@pytest.mark.parametrize("reply, want", [
    ('{"explanation": "a"}', "a"), ('```json\n{"explanation": "a"}\n```', "a"), ('{"explanation": "a"} trailing', None),
    ("{'explanation': 'single'}", None), ('{"explanation": "a"}]', None), ('{"explanation": "a"}}', None), ('{"explanation": "a"}, {"b": 1}', None),
    ('[{"explanation": "a"}]', None), ("plain", None), ('{"explanation": "a}{]["}', "a}{]["),
])
def test_strict_replies(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(text.parse_reply(F.col("r")).alias("e")).first().e == (want or reply)


def test_judgements(spark):
    replies = ['{"correctness": 4.0, "specificity": "3", "completeness": 9, "fluency": 2.5, "justification": "j"}', '{"correctness": 4} and', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [r.j for r in df.orderBy("i").select(text.parse_judgement(F.col("r")).alias("j")).collect()]
    assert (got[0].correctness, got[0].specificity, got[0].completeness, got[0].fluency) == (4, 3, None, None)
    assert got[1].correctness is None and got[1].justification.startswith("ERROR") and got[2].justification.startswith("ERROR")


def test_null_strata_get_their_share(spark):
    rows = [(f"{kind}{i}", kind) for kind in (None, "", "x") for i in range(20)]
    got = splits.group_split(spark.createDataFrame(rows, "video_id string, video_type string"), by=["video_type"])
    counts = {(r.video_type, r.split): r["count"] for r in got.groupBy("video_type", "split").count().collect()}
    assert all(counts[k, "eval"] == 3 and counts[k, "train"] == 17 for k in (None, "", "x"))


def test_balanced_sample_fails_on_an_empty_input(spark):
    with pytest.raises(Exception, match="fewer than"):
        P.balanced_sample(spark.createDataFrame([], "series_id long, label int"), 1, 1).collect()
    many = spark.range(4000).select(F.col("id").alias("series_id"), (F.col("id") % 2).cast("int").alias("label"))
    for n in (1000, 1001):
        assert P.balanced_sample(many, n, n).count() == 2 * n


def test_correlation_far_from_zero(spark):
    base = spark.range(2000).select(F.rand(1).alias("a"), F.rand(2).alias("b")).select("a", (F.col("a") + F.col("b")).alias("b"))
    want = base.agg(F.corr("a", "b")).first()[0]
    for offset in (0.0, 1e8):
        moved = base.select((F.col("a") + offset).alias("h"), (F.col("b") + offset).alias("g"))
        assert J.agreement(moved, {"c": ("h", "g")}).first().pearson == pytest.approx(want, abs=1e-6)


def test_any_number_of_strategies_and_swept_values(spark):
    names = [f"s{i}" for i in range(40)]
    rows = [(1, n, i, f) for i, n in enumerate(names) for f in range(i // 2, i // 2 + 3)]
    df = spark.createDataFrame(rows, "series_id int, strategy string, strategy_no int, frame int")
    assert sorted(r.strategy for r in P.distinct_strategies(df, names).collect()) == sorted(names[::2])
    swept = spark.range(60_000).select((F.col("id") % 12_000).alias("k"), F.rand(1).alias("score"), (F.col("id") % 2).alias("label"))
    assert M.threshold_sweep(swept, 3, by=["k"]).select("k").distinct().count() == 12_000


def test_few_rows_leave_the_local_step_of_retrieval(spark):
    vec = F.array(*[F.rand(i) - 0.5 for i in range(4)])
    side = spark.range(3000).withColumn("vec", vec)
    local = V.local_topk(side.withColumnRenamed("id", "query_id"), side.withColumnRenamed("id", "index_id"), 3, block=256, parts=16)
    assert local.count() == 3000 * 3 * 4  # k rows per query and strip of the index, whatever the number of blocks
