import random

import brute
import pytest

from scorewise.llm import templates

FIELDS = "doc_id long, text string"


def check(spark, rows, leading=4, min_docs=5, constant=0.6):
    found = templates.without_recurring_lines(spark.createDataFrame(rows, FIELDS), leading=leading, min_docs=min_docs, constant=constant)
    want = brute.templates(rows, leading, min_docs, constant)
    got = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr)
    assert got == sorted(((key, w) for (key, _), w in zip(rows, want)), key=repr)
    return found


@pytest.mark.parametrize("leading, min_docs, constant", [(1, 2, 0.5), (2, 3, 0.6), (4, 5, 0.6), (0, 2, 0.9)])
def test_small_vocabulary_matches_brute_force(spark, leading, min_docs, constant):
    draw = random.Random(leading + min_docs)
    line = lambda: " ".join(draw.choice(["a", "b", "c", "id7", "9", "dd"]) for _ in range(draw.randint(0, 6)))
    rows = [(i, "\n".join(line() for _ in range(draw.randint(1, 8)))) for i in range(60)]
    check(spark, rows, leading, min_docs, constant)


def test_variable_fields_are_generalised(spark):
    draw = random.Random(1)
    rows = []
    for i in range(30):
        name = "".join(draw.choices("abcdefgh", k=6))
        rows.append((i, f"own text of document {name}{i} and nothing else\nPosted by {name} on day {i} in the archive\nNote number {i}\r"))
    found = check(spark, rows)
    assert {r["text"].count("\n") for r in found.collect()} == {0} or all("Posted by" not in r["text"] for r in found.collect())


def test_odd_rows(spark, docs, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(spark, rows, min_docs=2)
    found = templates.without_recurring_lines(clashing, min_docs=2)
    assert found.columns == [*clashing.columns, "n_lines", "n_dropped"] and found.filter("line <> 'own line'").isEmpty()
    assert templates.without_recurring_lines(empty).count() == 0
    counts = {r["doc_id"]: r["n_lines"] for r in found.collect()}
    assert counts[6] == 0 and counts[7] == 0 and counts[8] == 2


def test_no_python_on_the_main_path(docs):
    plan = templates.without_recurring_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
