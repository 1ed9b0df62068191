import random

import brute
import pyarrow as pa
import pytest

from scorewise.llm import repeats


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.without_repeats(df, **options).collect()
    window = options.get("window", repeats.WINDOW)
    expected = brute.substring_dedup([t for _, t in rows], window)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr)
    assert got == sorted(((key, *e) for (key, _), e in zip(rows, expected)), key=repr)
    for r in found:
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_removed"]
        assert brute.sha(r["kept_text"]) == r["kept_sha256"]
    return found


def made(seed, docs=60, vocabulary=3, most=60):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice("abcdefgh"[:vocabulary]) for _ in range(draw.randint(0, most)))) for i in range(docs)]


@pytest.mark.parametrize("window, prefix, vocabulary", [(4, 2, 3), (5, 1, 2), (9, 4, 2), (12, 3, 1), (35, 8, 1)])
def test_small_vocabularies_match_brute_force(spark, window, prefix, vocabulary):
    check(spark, made(window * 7 + vocabulary, vocabulary=vocabulary), window=window, prefix=prefix)


@pytest.mark.parametrize("group_rows", [1, 3, 10**9])
def test_crowded_prefixes_give_the_same(spark, group_rows):
    check(spark, made(11), window=6, prefix=2, group_rows=group_rows)


def test_passages_across_documents(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdefghijklm", k=5))
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(80):
        body = [word() for _ in range(draw.randint(0, 90))]
        for passage in draw.sample(shared, 2):
            at = draw.randint(0, len(body))
            body[at:at] = passage
        rows.append((i, draw.choice([" ", "\n", " \t"]).join(body)))
    assert sum(r["n_removed"] for r in check(spark, rows)) > 1000
    check(spark, rows, group_rows=5)


def test_odd_rows(spark, docs, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(spark, rows)
    found = repeats.without_repeats(clashing)
    assert set(clashing.columns) - {"text"} <= set(found.columns) and found.count() == len(rows)
    assert found.filter("row <> 'own row' or listed <> 'own listed'").isEmpty()
    assert repeats.without_repeats(empty).count() == 0


def test_deep_nodes_name_equal_windows_equally():
    flags, windows = repeats.deep_nodes(pa.array(["a b c d e", "x a b c", "b c d", "", "q"], pa.string()), 3)
    assert windows.tolist() == [3, 2, 1, 0, 0] and flags.tolist() == [True, True, False, False, True, True]
