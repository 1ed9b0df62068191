"""Byte-level BPE against the tokenizer library, and round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from scorewise.llm import bpe

SPECIAL = "<|endoftext|> stays text"


def library(path=bpe.VOCABULARY, pattern=bpe.PATTERN):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    draw = random.Random(5)
    letters = "ab eé'sß \n\t漢字 12٣ .,!-\U0001F600  ́\x00\x85  "
    texts = ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(300)]
    return [*texts, " ", "  ", " a", "a ", "a  b", "\n a", "a\n b", "it's they'll I'd", SPECIAL, "a" * 700, "ab" * 400, "é" * 300, "zqxj" * 200]


def test_ids_are_those_of_the_library(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in bpe.encoded(df, keep=["doc_id"], block_words=500).collect()}
    encoding = library()
    for i, text in enumerate(texts):
        assert found[i].ids == encoding.encode_ordinary(text), text
        assert bytes(found[i].decoded) == text.encode() and found[i].n_tokens == len(found[i].ids)


def test_edge_cases(spark, docs, clashing, empty):
    encoding = library()
    for df in (docs, clashing):
        for r in bpe.encoded(df, whole=False).collect():
            ids = encoding.encode_ordinary(r["text"] or "")
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encoded(docs).count() == docs.count()  # repeated rows stay
    out = bpe.encoded(clashing)
    assert set(clashing.columns) <= set(out.columns)
    assert bpe.encoded(empty).count() == 0


def test_block_size_does_not_matter(spark, docs):
    key = lambda df: sorted((str(r.doc_id), r.ids_sha256) for r in df.collect())
    assert key(bpe.encoded(docs, whole=False, block_words=1)) == key(bpe.encoded(docs, whole=False))


def test_stored_ids_decode(spark):
    rows = spark.createDataFrame([(1, [0, 1, 2]), (2, []), (3, None)], "doc_id long, ids array<int>")
    pieces = bpe.ranks().pieces
    got = {r.doc_id: r.decoded for r in bpe.decoded(rows).collect()}
    assert bytes(got[1]) == b"".join(pieces[:3]) and bytes(got[2]) == b"" and got[3] is None


@pytest.fixture
def small(tmp_path):
    """A vocabulary in which merging ab first comes late, wvw is out of reach, and ranks do not rise with length."""
    words = [bytes([i]) for i in range(256)] + [b"wvw", b"xyx", b"ab", b"bcd", b"abc", b"xy", b"yx", b"cd", b"abcd"]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words)))
    return str(path)


def test_other_vocabulary(spark, small):
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcdxywv ", k=draw.randint(1, 30))) for _ in range(300)] + ["abc", "wvw", " wvw", "wvwv", "xyx", "bcd", "abcd", "xyxyxyx"]
    encoding = library(small)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bpe.ranks(small).unreached
    for r in bpe.encoded(df, vocabulary=small).collect():
        assert r.ids == encoding.encode_ordinary(r.text), r.text


def test_other_pattern(spark):
    texts = ["ab cd  ef", " x y ", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoding = library(pattern=r".{1,4}")
    for r in bpe.encoded(df, pattern=r".{1,4}").collect():
        assert r.ids == encoding.encode_ordinary(r.text)


def test_a_vocabulary_needs_every_byte(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError, match="every byte"):
        bpe.ranks(str(path))


def test_plan_has_no_shuffle(spark, docs):
    plan = bpe.encoded(docs, whole=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 2
