import random

import brute
import pytest

from scorewise.llm import decontaminate as D

FIELDS = "item_id long, text string"


def check(spark, docs, items, **options):
    bench = spark.createDataFrame(items, FIELDS)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = D.summary(D.overlaps(docs, bench, **options)).collect()
    expected = brute.contamination([t for _, t in rows], items, options.get("window", 10))
    want = sorted(((key, *e) for (key, _), e in zip(rows, expected)), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want
    return found


def planted(seed=3):
    """Texts over a tiny vocabulary, so that windows recur, overlap and break off by chance."""
    draw = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "été", "x1", "É"]
    sep = [" ", ", ", "-", "\n", "_", "  "]
    make = lambda n: "".join(draw.choice(vocabulary) + draw.choice(sep) for _ in range(n))
    return [(i, make(draw.randint(0, 80))) for i in range(120)], [(i, make(draw.randint(0, 14))) for i in range(40)]


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_small_vocabulary_matches_brute_force(spark, window):
    docs, items = planted()
    check(spark, spark.createDataFrame(docs, "doc_id long, text string"), [*items, (7, "twice"), (None, "a b")][:41], window=window)


def test_blocks_give_the_same_as_one_automaton(spark):
    docs, items = planted(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, FIELDS)
    one = {tuple(r) for r in D.summary(D.overlaps(df, bench, window=3)).collect()}
    many = {tuple(r) for r in D.summary(D.overlaps(df, bench, window=3, block_words=100)).collect()}
    assert one == many
    clean = {r["doc_id"] for r in D.uncontaminated(df, bench, window=3).collect()}
    assert clean == {r["doc_id"] for r in D.uncontaminated(df, bench, window=3, block_words=100).collect()}
    assert clean == {x[0] for x in one if not x[5]}


def test_odd_rows(spark, docs, clashing, empty):
    words = docs.filter("doc_id = 1").first()["text"].split()
    items = [(1, " ".join(words[20:45]).upper()), (2, None), (3, "..."), (4, ""), (5, "one"), (6, " ".join(words[20:45]))]
    found = check(spark, docs, items)
    assert sum(r["contaminated"] for r in found) >= 5
    bench = spark.createDataFrame(items, FIELDS)
    kept = D.uncontaminated(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == sum(not r["contaminated"] for r in found)
    check(spark, docs, [(1, None)])
    assert D.overlaps(empty, bench).count() == 0
    assert D.uncontaminated(docs, spark.createDataFrame([], FIELDS)).count() == docs.count()


def test_spans_point_at_the_original(spark):
    text = "Well: ÉTÉ — one,two THREE four?  five"
    bench = spark.createDataFrame([(1, "ONE two three")], FIELDS)
    row = D.overlaps(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench, window=3).first()
    (span,) = row["spans"]
    assert text[span["first"] : span["last"]] == "one,two THREE"
