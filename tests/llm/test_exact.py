import brute
from conftest import DOCS, prose

from scorewise.llm import exact


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def check(spark, rows, **options):
    found = exact.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    expected = brute.exact_groups(rows)
    want = sorted(
        ((key, *expected[i], brute.sha("".join(brute.words(text)))) for i, (key, text) in enumerate(rows)), key=repr
    )
    assert sorted((tuple(r) for r in found), key=repr) == want


def test_odd_rows_match_brute_force(spark, docs):
    check(spark, pairs(docs))


def test_every_length_of_shared_beginning(spark):
    """Texts that part at each byte around the ends of the rounds, and texts that are the beginning of others."""
    base = prose(7, 400).replace(" ", "é")
    rows, key = [], 0
    for cut in (0, 1, 2, 3, 4, 5, 8, 15, 16, 17, 63, 64, 65, 66, 127, 128, 129, 300):
        for text in (base[:cut], base[:cut] + "x", base[:cut] + "y", " " + base[:cut] + "\n", base[:cut] + "x"):
            rows.append((key := key + 1, text))
    check(spark, rows, first=2, growth=2)
    check(spark, rows, first=4, growth=4)
    check(spark, rows)


def test_ties_go_to_more_characters_then_smaller_id(spark):
    rows = exact.duplicate_groups(spark.createDataFrame([(3, "a b"), (2, "ab"), (1, "ab"), (9, "a  b")], "doc_id long, text string")).collect()
    assert {r["keep_id"] for r in rows} == {9} and [r["doc_id"] for r in rows if r["kept"]] == [9]


def test_what_stays(spark, docs, clashing, empty):
    stayed = exact.without_duplicates(docs)
    groups = brute.exact_groups(pairs(docs))
    assert stayed.columns == docs.columns and stayed.count() == sum(g[2] for g in groups.values())
    assert exact.without_duplicates(clashing).columns == clashing.columns
    assert exact.without_duplicates(clashing).filter("_hash <> 'own _hash'").isEmpty()
    assert exact.without_duplicates(clashing).select(docs.columns).exceptAll(stayed).isEmpty()
    assert exact.without_duplicates(empty).count() == 0 and exact.duplicate_groups(empty).count() == 0


def test_a_hot_group_of_one_text(spark):
    rows = [(i, "the same text" if i % 3 else f"text number {i}") for i in range(3000)]
    check(spark, rows)
    assert exact.without_duplicates(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)).count() == 1001
