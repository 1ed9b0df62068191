"""Seconds per operator on the driver tables: median of three runs after one warm-up.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the local cores. The score series
(about 600 000 rows at sf0.1) are derived once from ``lineitem`` and written, as a real series table would be.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scorewise.functions import arrays  # noqa: E402
from scorewise.operators import judged as J  # noqa: E402
from scorewise.operators import metrics as M  # noqa: E402
from scorewise.operators import sampling as P  # noqa: E402
from scorewise.operators import series as S  # noqa: E402
from scorewise.operators import vectors as V  # noqa: E402
from scorewise.operators.blocks import number_by_range  # noqa: E402
from scorewise.plans import fixtures as fx  # noqa: E402
from scorewise.plans import judged_queries as jq  # noqa: E402
from scorewise.session import configure  # noqa: E402
from scorewise.sources.shared import written  # noqa: E402


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("scorewise-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def hot_series(scores: DataFrame) -> DataFrame:
    """All scores once more, a third of the rows in one series with short runs."""
    rows = scores.withColumn("series_id", F.when(F.col("series_id") % 3 == 0, -1).otherwise(F.col("series_id")))
    return number_by_range(rows.withColumnRenamed("idx", "at"), ["series_id"], ["at", "score"], "idx").drop("at")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    scores = written(fx.bench(spark, sf), "bench")
    hot = written(hot_series(scores), "hot")
    hot_runs = written(S.threshold_runs(hot, 0.5), "hot-runs")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    items = fx.table(spark, sf, "lineitem").select("l_suppkey", *order)
    labelled = scores.withColumn("label", ((F.col("series_id") + F.col("idx")) % 5 == 0).cast("int"))
    runs = written(S.threshold_runs(scores, 0.5), "runs")
    segments = written(S.hysteresis_segments(scores, 0.5, 0.3, 3), "segments")
    unit = written(
        fx.table(spark, sf, "embeddings").select("vec_id", arrays.l2_normalize(F.col("embedding")).alias("vec")), "unit"
    )
    index, asked = unit.withColumnRenamed("vec_id", "index_id"), unit.withColumnRenamed("vec_id", "query_id")
    pairs = written(jq.pairs(spark, sf), "pairs")

    cases = {
        "number_series": lambda: number_by_range(items, ["l_suppkey"], order),
        "threshold_runs": lambda: S.threshold_runs(scores, 0.5),
        "hysteresis_segments": lambda: S.hysteresis_segments(scores, 0.5, 0.3, 3),
        "segment_summary": lambda: S.segment_summary(scores, segments, "exclusive"),
        "threshold_sweep": lambda: M.threshold_sweep(labelled, 400),
        "roc_auc": lambda: M.roc_auc(labelled),
        "budget_sample": lambda: P.budget_sample(scores, runs),
        "topk_similar": lambda: V.topk_similar(asked, index, 3),
        "paired_bootstrap": lambda: J.paired_bootstrap(pairs),
        "gaussian_smooth": lambda: S.gaussian_smooth(scores, 38, 11),
        "gaussian_smooth_wide": lambda: S.gaussian_smooth(scores, 900, 282),
        "minmax": lambda: S.minmax(scores),
        "series_summary": lambda: S.series_summary(scores, 0.5),
        "topk_mean": lambda: S.topk_mean(scores, 8),
        "rolling_meter": lambda: S.rolling_meter(scores),
        "pr_auc": lambda: M.pr_auc(labelled),
        "micro_macro_auc": lambda: M.micro_macro_auc(labelled),
        "hot_threshold_runs": lambda: S.threshold_runs(hot, 0.5),
        "hot_segment_summary": lambda: S.segment_summary(hot, hot_runs),
        "hot_topk_mean": lambda: S.topk_mean(hot, 5_000),
    }
    times: dict[str, float] = {}
    for name, case in cases.items():
        run(case())
        taken = []
        for _ in range(3):
            begun = time.time()
            run(case())
            taken.append(time.time() - begun)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_operator_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
