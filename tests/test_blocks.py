"""Block-wise operators against plain loops, with blocks so small that every series crosses many of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

import reference as ref
from scorewise.operators import blocks as B
from scorewise.operators import intervals as I
from scorewise.operators import metrics as M
from scorewise.operators import sampling as P
from scorewise.operators import series as S
from scorewise.operators import vectors as V

SIZES = (5, B.BLOCK_ROWS)


def make(seed=0, n_series=12, nan=False):
    rng = random.Random(seed)
    out = {}
    for sid in range(n_series):
        n = rng.choice([1, 2, 3, 8, 15, 40, 90])
        level = rng.random()
        x = []
        for _ in range(n):
            level = min(1.0, max(0.0, level + rng.uniform(-0.4, 0.4)))
            x.append(math.nan if nan and rng.random() < 0.1 else round(level, 3))
        out[sid] = x
    out[99] = [round(0.5 + 0.5 * math.sin(i / 5), 3) for i in range(300)]  # one long series
    return out


def frame(spark, data):
    rows = [(sid, i, float(s)) for sid, x in data.items() for i, s in enumerate(x)]
    return spark.createDataFrame(rows, "series_id long, idx long, score double").repartition(5)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("nan", [False, True])
def test_threshold_runs(spark, size, nan):
    data = make(1, nan=nan)
    want = sorted((sid, no, a, b) for sid, x in data.items()
                  for no, (a, b) in enumerate(ref.runs(x, lambda s: s > 0.5, lambda s: s <= 0.5)))
    assert rows(S.threshold_runs(frame(spark, data), 0.5, size=size), "series_id", "seg_no", "start_idx", "end_idx") == want


@pytest.mark.parametrize("size", SIZES)
def test_hysteresis(spark, size):
    data = make(2, nan=True)
    want = []
    for sid, x in data.items():
        kept = [(a, b + 1) for a, b in ref.runs(x, lambda s: s > 0.6, lambda s: s < 0.3) if b + 1 - a >= 3]
        want += [(sid, no, a, b) for no, (a, b) in enumerate(kept)]
    got = S.hysteresis_segments(frame(spark, data), 0.6, 0.3, 3, size=size)
    assert rows(got, "series_id", "seg_no", "start_idx", "end_idx") == sorted(want)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("range_,sigma", [(10, 3), (80, 25)])
def test_gaussian(spark, size, range_, sigma):
    data = make(3)
    got = {(r.series_id, r.idx): r.score for r in S.gaussian_smooth(frame(spark, data), range_, sigma, size=size).collect()}
    for sid, x in data.items():
        for i, s in enumerate(ref.smooth(x, range_, sigma)):
            assert got.pop((sid, i)) == pytest.approx(s, abs=1e-12)
    assert not got


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("budget,gap", [(8, 2), (12, 4), (2, 1)])
def test_budget_sample(spark, size, budget, gap):
    data = make(4)
    want = []
    for sid, x in data.items():
        segs = ref.runs(x, lambda s: s > 0.3, lambda s: s <= 0.3)
        want += [(sid, no, i) for no, i in ref.picks(x, segs, budget, gap)] if segs else []
    df = frame(spark, data)
    got = P.budget_sample(df, S.threshold_runs(df, 0.3), budget, gap, size=size)
    assert rows(got, "series_id", "seg_no", "idx") == sorted(want)


@pytest.mark.parametrize("size", SIZES)
def test_rolling_meter(spark, size):
    data = make(5)
    got = {(r.series_id, r.idx): r for r in S.rolling_meter(frame(spark, data), 6, size=size).collect()}
    for sid, x in data.items():
        for i, want in enumerate(ref.meter(x, 6)):
            r = got.pop((sid, i))
            assert (r["median"], r["mean"], r["max"], r["value"], r["global_mean"]) == pytest.approx(want)
    assert not got


@pytest.mark.parametrize("size", SIZES)
def test_neighbours_and_totals(spark, size):
    data = make(6)
    df = frame(spark, data)
    for edge in ("self", "clamp"):
        got = {(r.series_id, r.idx): r.absdiff for r in S.centered_absdiff(df, 3, edge, size=size).collect()}
        for sid, x in data.items():
            for i in range(len(x)):
                lo, hi = (i - 3, i + 3)
                if edge == "clamp":
                    lo, hi = max(0, lo), min(len(x) - 1, hi)
                else:
                    lo, hi = (i if lo < 0 else lo), (i if hi >= len(x) else hi)
                assert got.pop((sid, i)) == pytest.approx(abs(x[lo] - x[hi]))
        assert not got
    scaled = {(r.series_id, r.idx): r.score for r in S.minmax(df, size=size).collect()}
    rough = {r.series_id: r.roughness for r in S.series_roughness(df, size=size).collect()}
    for sid, x in data.items():
        assert rough[sid] == pytest.approx(sum((b - a) ** 2 for a, b in zip(x, x[1:])))
        width = max(x) - min(x)
        for i, s in enumerate(x):
            assert scaled[(sid, i)] == pytest.approx(s if width < 1e-8 else (s - min(x)) / width)


@pytest.mark.parametrize("size", SIZES)
def test_running_best(spark, size):
    data = make(7)
    want = []
    for sid, x in data.items():
        best = -1
        for i in range(6, len(x)):
            if i % 2 == 0:
                want.append((sid, i, x[i] > best))
                best = max(best, x[i])
    got = S.running_best(frame(spark, data), 5, 2, size=size)
    assert rows(got, "series_id", "idx", "is_best") == sorted(want)


@pytest.mark.parametrize("ranges", [3, 10_000])
def test_curve_areas(spark, ranges):
    rng = random.Random(8)
    data = [(k, rng.randrange(20) / 20, int(rng.random() < 0.4)) for k in (1, 2, 3) for _ in range(60)]
    df = spark.createDataFrame(data, "series_id long, score double, label int")
    s, y = [d[1] for d in data], [d[2] for d in data]
    assert M.roc_auc(df, ranges=ranges).first().auc == pytest.approx(ref.auc(s, y))
    assert M.pr_auc(df, ranges=ranges).first().pr_auc == pytest.approx(ref.pr_area(s, y))
    by_key = {r.series_id: r.auc for r in M.roc_auc(df, ["series_id"], ranges=ranges).collect()}
    for k in (1, 2, 3):
        assert by_key[k] == pytest.approx(ref.auc([d[1] for d in data if d[0] == k], [d[2] for d in data if d[0] == k]))


@pytest.mark.parametrize("ranges", [1, 64])
def test_number_by_range(spark, ranges):
    rng = random.Random(9)
    data = [(k, rng.randrange(30), i) for i, k in enumerate([1] * 70 + [2] * 20 + [3])]
    df = spark.createDataFrame(data, "k long, at long, id long").repartition(6)
    want = sorted((k, i, n) for key in (1, 2, 3) for n, (k, _, i) in enumerate(sorted(d for d in data if d[0] == key)))
    assert rows(B.number_by_range(df, ["k"], ["at", "id"], ranges=ranges), "k", "id", "idx") == want


def test_number_rows_global(spark):
    df = spark.range(500).withColumn("h", F.md5(F.col("id").cast("string")))
    prefix = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    got = [r.id for r in B.number_rows(df, (), ["h"], prefix, "pos").orderBy("pos").collect()]
    assert got == [r.id for r in df.orderBy("h").collect()]


@pytest.mark.parametrize("size", SIZES)
def test_range_join(spark, size):
    data = make(10)
    spans = [(sid, a, a + w) for sid in data for a, w in ((0, 5), (3, 0), (2, 200), (50, 20))]
    df = spark.createDataFrame(spans, "series_id long, start_idx long, end_idx long")
    got = B.range_join(frame(spark, data), df)
    want = sorted((sid, i, a, b) for sid, a, b in spans for i in range(len(data[sid])) if a <= i <= b)
    assert rows(got, "series_id", "idx", "start_idx", "end_idx") == want


@pytest.mark.parametrize("size", SIZES)
def test_dense_labels(spark, size):
    videos = spark.createDataFrame([(1, 30), (2, 5), (3, 41)], "series_id long, n_frames long")
    spans = [(1, 3, 9), (1, 8, 20), (1, 22, 22), (2, 0, 99), (3, 39, 40)]
    df = spark.createDataFrame(spans, "series_id long, start_frame long, end_frame long")
    got = rows(I.intervals_to_labels(videos, df, size), "series_id", "frame", "label")
    want = [(sid, f, int(any(s == sid and a <= f <= b for s, a, b in spans))) for sid, n in ((1, 30), (2, 5), (3, 41)) for f in range(n)]
    assert got == want


@pytest.mark.parametrize("size", SIZES)
def test_temporal_pool(spark, size):
    lengths = {1: 1, 2: 3, 3: 32, 4: 45, 5: 100}
    data = [(sid, i, [float(i), float(i * i)]) for sid, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(data, "series_id long, idx long, vec array<double>")
    got = {(r.series_id, r.bucket): r.vec for r in V.temporal_pool(df, size=size).collect()}
    for sid, n in lengths.items():
        for b in range(32):
            lo, hi = b * n // 32, (b + 1) * n // 32
            own = range(lo, max(lo + 1, hi))
            want = [sum(own) / len(own), sum(i * i for i in own) / len(own)]
            assert got[(sid, b)] == pytest.approx(want)


def test_partition_invariance(spark):
    data = make(11)
    results = []
    for partitions in ("1", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = frame(spark, data)
        results.append(rows(P.adaptive_segments(df, 0.9, size=16), "series_id", "threshold", "seg_no", "idx"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_adaptive_matches_loop(spark):
    data = make(12)
    want = []
    for sid, x in data.items():
        for t in (0.9, 0.9 * 0.67, 0.9 * 0.33, 0.05):
            segs = ref.runs(x, lambda s: s > t, lambda s: s <= t)
            chosen = ref.picks(x, segs, 8, 2) if segs else []
            if len(chosen) >= 4:
                break
        else:
            top = sorted(range(len(x)), key=lambda i: (-x[i], i))[:8]
            t, chosen = 0.0, ref.picks(x, [(min(top), max(top))], 8, 2)
        want += [(sid, round(t, 3), no, i) for no, i in chosen]
    got = rows(P.adaptive_segments(frame(spark, data), 0.9), "series_id", "threshold", "seg_no", "idx")
    assert got == sorted(want)


@pytest.mark.parametrize("limit", [4, 1000])
def test_top_rows_beyond_the_pushed_limit(spark, limit, monkeypatch):
    monkeypatch.setattr(B, "GROUP_LIMIT", limit)
    data = make(13)
    want = sorted((sid, i, n + 1) for sid, x in data.items()
                  for n, i in enumerate(sorted(range(len(x)), key=lambda i: (-x[i], i))[:20]))
    got = B.top_rows(frame(spark, data), B.KEY, 20)
    assert rows(got, "series_id", "idx", "_rn") == want


@pytest.mark.parametrize("size", [1, 4, 1 << 16])
def test_next_event(spark, size):
    rng = random.Random(11)
    events = [(k, rng.randrange(200)) for k in (1, 2) for _ in range(30)] + [(3, 5)]
    points = [(k, rng.randrange(220), i) for i, k in enumerate([1] * 300 + [2] * 20 + [3, 4])]  # a hot key, one without events
    got = B.next_event(
        spark.createDataFrame(points, "series_id long, start_idx long, n long"), spark.createDataFrame(events, "series_id long, idx long"), size=size
    )
    want = {n: min((e for key, e in events if key == k and e >= p), default=None) for k, p, n in points}
    assert {r.n: r._next for r in got.collect()} == want


def test_take_while_on_overlapping_tracks(spark):
    rng = random.Random(12)
    sizes = [rng.choice([100.0, 900.0, 900.0, 900.0]) for _ in range(300)]
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate(sizes)], "series_id long, idx long, size double")
    tracks = [(1, n, a := rng.randrange(300), a + rng.randrange(1, 60)) for n in range(80)]
    got = S.take_while(frames, spark.createDataFrame(tracks, "series_id long, track_no long, start_idx long, end_idx long"))
    want = []
    for _, n, a, z in tracks:
        for i in range(a, min(z, 300)):
            if sizes[i] < 800:
                break
            want.append((n, i))
    assert sorted((r.track_no, r.idx) for r in got.collect()) == sorted(want)


def test_dense_labels_move_no_frame(spark):
    """Shuffles and sorts see spans and blocks; frames come last."""
    videos = spark.createDataFrame([(1, 300), (2, 5), (3, 0), (4, 17), (None, 2)], "series_id long, n_frames long")
    spans = spark.createDataFrame([(1, -5, 3), (1, 3, 9), (1, 60, 130), (1, 290, 400), (2, 5, 8), (4, 0, 16), (9, 0, 9), (None, 0, 1)], "series_id long, start_frame long, end_frame long")
    df = I.intervals_to_labels(videos, spans, 64)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    frames = next(i for i, line in enumerate(plan) if "Generate explode(sequence(lo" in line)
    assert not any(word in line for line in plan[:frames] for word in ("Sort", "Window", "Join", "Repartition"))
    got = sorted((r.series_id or 0, r.frame, r.label) for r in df.collect())
    told = [(r.series_id, r.start_frame, r.end_frame) for r in spans.collect()]
    want = [(s or 0, f, int(any(s is not None and s == t and a <= f <= z for t, a, z in told))) for s, n in ((1, 300), (2, 5), (4, 17), (None, 2)) for f in range(n)]
    assert got == sorted(want)
