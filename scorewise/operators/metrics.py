"""Detector evaluation: confusion measures, sweeps, exact curve areas, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import KEY, attach, earlier_ranges, number_by_range, prefix_by_range, ranged, top_rows, within

K_GRID = (1, 3, 5, 8, 10, 15, 20, 30, 50)  # fixed values: the searched k


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _rates(df: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, F1 and balanced accuracy to rows with tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rows = df.withColumns({
        "accuracy": _share(tp + tn, tp + tn + fp + fn),
        "precision": _share(tp, tp + fp),
        "recall": _share(tp, tp + fn),
    })
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumns({
        "f1": _share(2.0 * p * r, p + r),
        "balanced_accuracy": 0.5 * (r + _share(tn, tn + fp)),
    })


def confusion_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates in one pass."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    return _rates(counts)


# --- threshold sweeps ------------------------------------------------------------------------------------------

def threshold_sweep(
    df: DataFrame, steps: int = 400, lo: float | None = None, hi: float | None = None, op: str = ">=",
    label: str = "label", score: str = "score", by: Sequence[str] = (),
) -> DataFrame:
    """Confusion rates at ``steps`` evenly spaced thresholds between the score bounds (or ``lo`` and ``hi``).

    Every row is binned once by the number of thresholds it passes and the counts are accumulated over the bins, so
    the work is one aggregation whatever the number of thresholds. ``by`` names swept parameters such as k, with any
    number of values: the rows of a value are dealt to many tasks to meet its bounds.
    """
    bounds = df.groupBy(*by).agg(F.min(score).alias("_min"), F.max(score).alias("_max"))
    bounds = bounds.select(
        *by,
        F.lit(lo).cast("double").alias("_lo") if lo is not None else F.col("_min").alias("_lo"),
        F.lit(hi).cast("double").alias("_hi") if hi is not None else F.col("_max").alias("_hi"),
    )
    width = F.col("_hi") - F.col("_lo")
    bounds = bounds.withColumn("_count", F.when(width < 1e-12, F.lit(1)).otherwise(F.lit(steps)))
    bounds = bounds.withColumn("_step", width / F.greatest(F.col("_count") - 1, F.lit(1)))

    def threshold(i: Column) -> Column:
        return F.when((i == F.col("_count") - 1) & (i > 0), F.col("_hi")).otherwise(F.col("_lo") + i * F.col("_step"))

    if by:
        rows = attach(df.select(*by, label, score), bounds, list(by), F.col(score), "inner")
    else:
        one = bounds.select(F.struct("_lo", "_hi", "_count", "_step").alias("b"))
        rows = df.select(label, score).withColumn("_b", one.scalar()).select(label, score, "_b.*")
    s = F.col(score)
    guess = F.when(F.col("_step") > 0, F.floor((s - F.col("_lo")) / F.col("_step"))).otherwise(0)
    start = F.least(F.greatest(guess - 1, F.lit(0)), F.col("_count") - 1).cast("int")
    near = F.sequence(start, F.least(start + 3, F.col("_count") - 1))
    passes = (lambda i: threshold(i) <= s) if op == ">=" else (lambda i: threshold(i) < s)
    passed = F.coalesce(F.array_max(F.filter(near, passes)) + 1, start)
    binned = rows.withColumn("_bin", passed).groupBy(*by, "_bin").agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )

    grid = bounds.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    grid = grid.select(*by, "step", threshold(F.col("step")).alias("threshold"), (F.col("step") + 1).alias("_bin"))
    filled = grid.join(binned, [*by, "_bin"], "left")
    above = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumns({
        "tp": F.coalesce(F.sum("_pos").over(above), F.lit(0)), "fp": F.coalesce(F.sum("_neg").over(above), F.lit(0)),
    })
    totals = binned.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    if by:
        filled = filled.join(totals, list(by))
    else:
        filled = filled.withColumn("_t", totals.select(F.struct("_p", "_n").alias("t")).scalar())
        filled = filled.select("*", "_t.*")
    counts = filled.select(
        *by, "step", "threshold", "tp", (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn")
    )
    return _rates(counts)


RANKING = ("accuracy", "f1", "balanced_accuracy")


def best_threshold(sweep: DataFrame, by: Sequence[str] = (), ranking: Sequence[str] = RANKING) -> DataFrame:
    """First sweep row with the largest ranking tuple."""
    row = F.struct(*[c for c in sweep.columns if c not in by])
    order = F.struct(*[F.col(c) for c in ranking], -F.col("step"))
    return sweep.groupBy(*by).agg(F.max_by(row, order).alias("r")).select(*by, "r.*")


def topk_means(df: DataFrame, ks: Sequence[int], keys: Sequence[str] = KEY) -> DataFrame:
    """Mean of the top k scores of every series for each k, from one ranking."""
    each = top_rows(df, keys, max(ks)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("_rn") <= F.col("k"))
    return each.groupBy(*keys, "k").agg(F.avg("score").alias("video_score"))


def grid_search_k_threshold(df: DataFrame, labels: DataFrame, ks: Sequence[int] = K_GRID, steps: int = 200) -> DataFrame:
    """Sweep rows for every k of the grid."""
    scored = topk_means(df, ks).join(labels.select("series_id", "label"), "series_id")
    return threshold_sweep(scored, steps, score="video_score", by=["k"])


def calibrate_and_apply(df: DataFrame, methods: Sequence[str], calibration: DataFrame, steps: int = 400) -> DataFrame:
    """Sweep each method's score on the calibration series, keep the best method, apply it to all series.

    ``df`` has series_id, label and one score column per method; earlier methods win ties.
    """
    sample = df.join(calibration.select("series_id"), "series_id", "left_semi")
    entries = [F.struct(F.lit(m).alias("method"), F.lit(i).alias("method_no"), F.col(m).alias("score")) for i, m in enumerate(methods)]
    long = sample.select("label", F.inline(F.array(*entries)))
    best = best_threshold(threshold_sweep(long, steps, by=["method", "method_no"]), ["method", "method_no"])
    order = F.struct(*RANKING, -F.col("method_no"))
    winner = best.agg(F.max_by(F.struct("method", "threshold"), order).alias("w")).scalar()
    rows = df.withColumn("_w", winner)
    value = F.coalesce(*[F.when(F.col("_w.method") == m, F.col(m)) for m in methods])
    rows = rows.withColumn("video_score", value)
    hit = F.when(F.col("video_score") >= F.col("_w.threshold"), 1).otherwise(0)
    return rows.select(
        "series_id", "label", F.col("_w.method").alias("method"), F.col("_w.threshold").alias("threshold"),
        "video_score", hit.alias("prediction"),
    )


def apply_calibration(
    df: DataFrame, labels: DataFrame, params: DataFrame | None = None, k: int | None = None, threshold: float | None = None
) -> DataFrame:
    """Top-k mean and decision with stored parameters (a one-row ``k, threshold`` report) or with both given."""
    if (k is None) != (threshold is None):
        raise ValueError("give both k and threshold, or neither")
    if k is None:
        if params is None:
            raise ValueError("no stored parameters")
        # a scalar subquery, which fails on a report of several rows; the order is that of top_rows
        report = params.select(F.struct(F.col("k").cast("long").alias("k"), F.col("threshold").cast("double").alias("t")).alias("r"))
        order = [~F.isnan("score"), F.col("score").isNull(), -F.col("score"), "idx"]
        best = number_by_range(df.select("series_id", "idx", F.col("score").cast("double")), ["series_id"], order, "_rn", 1)
        best = best.withColumn("_r", report.scalar()).filter(F.col("_rn") <= F.greatest(F.lit(1), F.col("_r.k")))
        threshold = F.col("_threshold")
    else:
        best = top_rows(df, ("series_id",), max(1, k)).withColumn("_r", F.struct(F.lit(float(threshold)).alias("t")))
        threshold = F.lit(float(threshold))
    scored = best.groupBy("series_id").agg(F.avg("score").alias("video_score"), F.first("_r.t").alias("_threshold"))
    hit = F.when(F.col("video_score") >= threshold, 1).otherwise(0)
    rows = scored.join(labels.select("series_id", "label"), "series_id")
    return rows.select("series_id", "label", "video_score", hit.alias("prediction"))


# --- curves ----------------------------------------------------------------------------------------------------

def _steps(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """One row per distinct score with its positives and negatives: a score shared by many rows costs one row."""
    one_if = lambda y: (F.col(label) == y).cast("long")
    rows = df.select(*by, F.col(score).alias("score"), one_if(1).alias("pos"), one_if(0).alias("neg"))
    return rows.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _ladder(steps: DataFrame, by: Sequence[str], ranges: int | None) -> DataFrame:
    """Steps with the positives and negatives strictly below them, and those of the whole key as P and N."""
    sums = {"pos_below": F.col("pos"), "neg_below": F.col("neg")}
    rows = prefix_by_range(steps, by, ["score"], ranges, totals=tuple(sums), **sums)
    return rows.withColumnsRenamed({"all_pos_below": "P", "all_neg_below": "N"})


def _areas(cut: DataFrame, by: Sequence[str], anchors: Column | None = None, extra: int = 0) -> DataFrame:
    """Area per key from the steps that ``ranged`` has put in order: pairs won inside a range, and by the positives of a range
    over all negatives of earlier ranges. ``anchors`` adds pairs won by ``extra`` more rows of each class."""
    pos, neg = F.col("pos"), F.col("neg")
    below = F.sum("neg").over(within(by, "_at").rowsBetween(Window.unboundedPreceding, -1))
    inside = cut.withColumn("_below", F.coalesce(below, F.lit(0)))
    won = F.sum(pos * (F.col("_below") + neg / 2)) + (F.lit(0.0) if anchors is None else anchors)
    parts = inside.groupBy(*by, "blk").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), won.alias("won"))
    parts = parts.withColumn("_below", F.coalesce(F.sum("neg").over(earlier_ranges(by)), F.lit(0)))
    pairs = (F.sum("pos") + extra).cast("double") * (F.sum("neg") + extra)
    wins = F.sum(F.col("won") + pos * F.col("_below")) + extra
    return parts.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def roc_auc(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", ranges: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve, ties by trapezoid; null when a class is missing."""
    return _areas(ranged(_steps(df, by, label, score), by, ["score"], ranges), by)


def roc_curve(
    df: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None
) -> DataFrame:
    """One point per distinct threshold (``score >= threshold``)."""
    rows = _ladder(_steps(df, (), label, score), (), ranges)
    return rows.select(
        F.col("score").alias("threshold"),
        ((F.col("N") - F.col("neg_below")) / F.col("N")).alias("fpr"),
        ((F.col("P") - F.col("pos_below")) / F.col("P")).alias("tpr"),
    )


def pr_curve(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", ranges: int | None = None
) -> DataFrame:
    """Precision and recall per distinct threshold, with those of the next higher threshold (start: 1 and 0)."""
    rows = _ladder(_steps(df, by, label, score), by, ranges)
    hits, misses = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    hits_next, misses_next = hits - F.col("pos"), misses - F.col("neg")
    flagged_next = hits_next + misses_next
    return rows.select(
        *by, F.col("score").alias("threshold"),
        (hits / (hits + misses)).alias("precision"), (hits / F.col("P")).alias("recall"),
        F.when(flagged_next > 0, hits_next / flagged_next).otherwise(1.0).alias("next_precision"),
        (hits_next / F.col("P")).alias("next_recall"),
    )


def pr_auc(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", ranges: int | None = None
) -> DataFrame:
    """Trapezoidal area under the precision-recall curve."""
    step = (F.col("recall") - F.col("next_recall")) * (F.col("precision") + F.col("next_precision")) / 2
    return pr_curve(df, by, label, score, ranges).groupBy(*by).agg(F.sum(step).alias("pr_auc"))


def micro_macro_auc(df: DataFrame, keys: Sequence[str] = KEY, ranges: int | None = None) -> DataFrame:
    """Pooled area, and the mean of per-series areas after adding the anchors (0, label 0) and (1, label 1).

    The steps of the series are counted once; summed over the series they are the steps of the pooled curve.
    """
    cut = ranged(_steps(df, keys, "label", "score"), keys, ["score"], ranges)
    pooled = cut.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    # pairs won by the positive anchor, against the negative anchor, and by one anchor over the other
    over = F.sum(F.when(score < 1, neg).when(score == 1, neg / 2).otherwise(0))
    under = F.sum(F.when(score > 0, pos).when(score == 0, pos / 2).otherwise(0))
    per_series = _areas(cut, keys, over + under, extra=1)
    macro = per_series.agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_series"))
    micro = _areas(ranged(pooled, (), ["score"], ranges), ()).scalar()
    return macro.select(micro.alias("micro_auc"), "macro_auc", "n_series")


# --- reports ---------------------------------------------------------------------------------------------------

def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of classes 0 and 1, with their macro and weighted means."""
    y, p = F.col(label), F.col(prediction)
    counts = df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    per_class = F.inline(F.array(
        F.struct(F.lit("0").alias("name"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")),
        F.struct(F.lit("1").alias("name"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed")),
    ))
    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    rows = counts.select(per_class).select(
        "name", _share(hit, hit + wrong).alias("precision"), _share(hit, hit + missed).alias("recall"),
        _share(2.0 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"),
    )
    measures = ("precision", "recall", "f1")
    weight = F.col("support") / F.sum("support").over(Window.partitionBy())
    rows = rows.withColumn("weight", weight)
    macro = rows.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = rows.agg(*[F.sum(F.col(m) * F.col("weight")).alias(m) for m in measures], F.sum("support").alias("support"))
    return (
        rows.drop("weight")
        .unionByName(macro.withColumn("name", F.lit("macro avg")))
        .unionByName(weighted.withColumn("name", F.lit("weighted avg")))
    )


def sens_spec(df: DataFrame, denominator: str = "all", by: Sequence[str] = ()) -> DataFrame:
    """Sensitivity and specificity with undecided (null) rows.

    ``all`` divides by every row of the class, ``decided`` by the rows with an answer.
    """
    if denominator not in ("all", "decided"):
        raise ValueError("denominator is 'all' or 'decided'")
    bad, said = F.col("ground_truth") == "anomalous", F.col("is_anomalous")
    good = F.col("ground_truth") == "normal"
    score = F.col("anomaly_score")
    rows = df.groupBy(*by).agg(
        F.count_if(bad).alias("n_anomalous"), F.count_if(good).alias("n_normal"),
        F.count_if(bad & said).alias("tp"), F.count_if(bad & ~said).alias("fn"),
        F.count_if(good & ~said).alias("tn"), F.count_if(good & said).alias("fp"),
        F.count_if(said.isNull()).alias("errors"),
        F.coalesce(F.avg(F.when(bad, score)), F.lit(0.0)).alias("avg_anomalous_score"),
        F.coalesce(F.avg(F.when(good, score)), F.lit(0.0)).alias("avg_normal_score"),
    )
    if denominator == "all":
        base_p, base_n = F.col("n_anomalous"), F.col("n_normal")
    else:
        base_p, base_n = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return rows.withColumns({"sensitivity": _share(F.col("tp"), base_p), "specificity": _share(F.col("tn"), base_n)})


def suggestibility(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False-positive rate on altered normal rows, and the verdict it gives."""
    said = F.col("is_anomalous")
    rows = df.groupBy(*by).agg(
        F.count(said).alias("n_valid"), F.count_if(said).alias("fp"), F.count_if(~said).alias("tn"),
        F.count_if(said.isNull()).alias("errors"),
        F.sum(F.when(said.isNotNull(), F.col("anomaly_score"))).alias("_s"),
    )
    rate = F.col("fp_rate")
    verdict = F.when(rate > 0.3, "suggestible").when(rate > 0.1, "partially suggestible").otherwise("robust")
    return rows.withColumns({
        "fp_rate": _share(F.col("fp"), F.col("n_valid")),
        "avg_score": F.coalesce("_s", F.lit(0)) / F.greatest(F.lit(1), F.col("n_valid")),
    }).drop("_s").withColumn("verdict", verdict)


def gate_summary(df: DataFrame) -> DataFrame:
    """Number of flagged and skipped series with mean, smallest and largest gate score."""
    return df.groupBy("flagged").agg(
        F.count("*").alias("n"), F.avg("gate_score").alias("mean_score"),
        F.min("gate_score").alias("min_score"), F.max("gate_score").alias("max_score"),
    )


def detection_rate(df: DataFrame, detected: Column, iou: str | None = None) -> DataFrame:
    """Share of rows detected; mean IoU over the positive ones."""
    hits = F.count_if(F.coalesce(detected, F.lit(False)))
    out = [hits.alias("detected"), F.count("*").alias("total"), _share(hits, F.count("*")).alias("rate")]
    if iou is not None:
        out.append(F.avg(F.when(F.col(iou) > 0, F.col(iou))).alias("mean_iou"))
    return df.agg(*out)
