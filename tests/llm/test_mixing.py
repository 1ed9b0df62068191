import collections

import brute
import pytest
from conftest import DOCS, prose  # noqa: F401
from pyspark.sql import functions as F

from scorewise.llm import mixing


def water(sizes, weights, most):
    """Share by weight, stop what is above, reshare the rest, until none is above."""
    targets, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        above = [s for s in open_ if most * sizes[s] <= left * weights[s] / total]
        if not above:
            return targets | {s: left * weights[s] / total for s in open_}
        for s in above:
            targets[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in above)
        open_ -= set(above)
    return targets


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 50], [5, 0, 3, 900, 7, 7, 2], [4], [100, 1, 1, 1, 1, 1, 1]])
def test_targets_are_the_fixed_point_of_resharing(spark, sizes):
    rows = [(i, prose(i, n) if n else "", None, f"s{i}", 0) for i, n in enumerate(sizes)]
    found = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, DOCS)).collect()}
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    weights = {f"s{i}": (5, 2, 1)[i % 3] for i in range(len(sizes))}
    for source, target in water(named, weights, 3).items():
        assert found[source]["target"] == pytest.approx(target) and found[source]["source_size"] == named[source]
    assert sum(r["target"] for r in found.values()) == pytest.approx(sum(sizes))


def test_copies_follow_the_rate(spark):
    rows = [(i, "w " * 10, None, "big" if i % 10 else "small", 0) for i in range(5000)]
    df = spark.createDataFrame(rows, DOCS)
    counted = mixing.with_copies(df)
    for r in counted.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * 10).alias("taken")).collect():
        assert r["taken"] == pytest.approx(r["t"], rel=0.05)
    assert counted.filter("copies > 3 or copies < 0").count() == 0
    mix = collections.Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    assert mix == {r["doc_id"]: r["copies"] for r in counted.collect() if r["copies"]}
    assert mix == collections.Counter(r["doc_id"] for r in mixing.mixed(df.repartition(7)).collect())


def test_odd_rows(spark, docs, clashing, empty):
    rows = mixing.with_copies(docs).collect()
    assert len(rows) == docs.count()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.words(r["text"]))
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    order = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    expected = water({s: n for s, n in sizes.items()}, {s: (5, 2, 1)[i % 3] for s, i in order.items()}, 3)
    assert all(r["target"] == pytest.approx(expected[r["source"]]) for r in rows)
    assert mixing.mixed(empty).count() == 0 and mixing.with_copies(empty).count() == 0
    mix = mixing.mixed(clashing)
    assert mix.columns == [c for c in clashing.columns if c != "copy"] + ["copy"]
    assert mix.select("doc_id", "copy").exceptAll(mixing.mixed(docs).select("doc_id", "copy")).isEmpty()
    assert mix.filter("copies <> 'own copies'").isEmpty()


def test_no_python_on_the_main_path(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
