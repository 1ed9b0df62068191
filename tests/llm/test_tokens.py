import random

import pytest
from pyspark.sql import functions as F

from scorewise.llm import tokens

PARTS = ["word", " two", "  ", "\n\n", "'s", "'ll", "it's", "123", " 4", "!?", " é", "\t x", "'", "\U0001F600", " ", "re", "we're   ", "汉字"]


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter()


@pytest.mark.parametrize("seed", range(12))
def test_edits_equal_counting_from_the_start(counter, seed):
    draw = random.Random(seed)
    make = lambda n: "".join(draw.choices(PARTS, k=n))
    text = make(draw.choice([0, 1, 3, 40, 900]))
    pieces = counter.cut(text)
    tree = tokens.Tree(pieces, counter.tokens(pieces))
    for _ in range(120):
        start, size, put = draw.randint(0, len(text)), draw.choice([0, 0, 1, 2, 5, 40]), make(draw.choice([0, 1, 1, 4, 30]))
        if draw.random() < 0.03:
            put = make(700)
        tree.edit(counter, start, size, put)
        text = text[:start] + put + text[start + size :]
        assert tree.flat()[0] == counter.cut(text)
        assert tree.n_chars == len(text) and tree.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_only_the_touched_region_is_encoded_again(counter):
    pieces = counter.cut("some plain words here. " * 5000)
    tree = tokens.Tree(pieces, counter.tokens(pieces))
    for i in range(50):
        tree.edit(counter, i * 2000, 3, "new")
    assert tree.encoded < 50 * 8


def test_state_goes_through_tables(spark, counter, docs):
    state = tokens.built(docs.select("doc_id", "text", tokens.revisions().alias("edits")))
    once = tokens.edited(state)
    again = tokens.edited(once.select("doc_id", "text", "piece_chars", "piece_tokens", tokens.revisions(rounds=5).alias("edits")))
    rows = again.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["n_tokens"] == len(counter.encoding.encode_ordinary(r["text"])) == sum(r["piece_tokens"])
        assert r["n_chars"] == len(r["text"]) and [len(p) for p in counter.cut(r["text"])] == r["piece_chars"]


def test_odd_edits(spark, counter, docs, clashing, empty):
    edits = F.expr("array(named_struct('start', cast(null as int), 'size', -5, 'put', cast(null as string)), named_struct('start', 1000000000, 'size', 7, 'put', 'end'))")
    state = tokens.built(clashing.drop("edits")).withColumn("edits", F.when(F.col("doc_id") > 3, edits))
    for r in tokens.edited(state).collect():
        assert r["n_tokens"] == len(counter.encoding.encode_ordinary(r["text"])) and r["n_edits"] == (2 if (r["doc_id"] or 0) > 3 else 0)
    assert tokens.edited(tokens.built(empty).withColumn("edits", edits)).count() == 0
    assert tokens.edited(state).filter("row <> 'own row'").isEmpty()
