"""What the physical plans must and must not contain."""

import pytest

from scorewise.operators import sampling as P
from scorewise.operators import series as S
from scorewise.plans import fixtures as fx
from scorewise.sources.shared import written

SF = "/root/testdata/sf0.001"


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark):
    """A stored series, so that a plan shows the operator and not how its input came about."""
    return written(fx.labelled_scores(spark, SF), "stored")


def test_runs_shuffle_their_rows_once(spark, stored):
    text = plan(S.threshold_runs(stored.select("series_id", "idx", "score"), 0.5), run=True)
    assert text.count("FileScan parquet") == 1 and "ReusedExchange" in text


@pytest.mark.parametrize("build", [lambda s: S.topk_mean(s, 8), lambda s: S.topk_span(s, 8)])
def test_topk_is_cut_before_the_shuffle(spark, build):
    text = plan(build(fx.scores(spark, SF)))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_budget_sample_gathers_few_rows(spark):
    scores = fx.scores(spark, SF)
    assert "WindowGroupLimit" in plan(P.budget_sample(scores, S.threshold_runs(scores, 0.5)))


def test_only_needed_columns_are_read(spark, stored):
    text = plan(S.series_mean(stored))
    assert "ReadSchema: struct<series_id:bigint,score:double>" in text
