"""The registered queries on the driver's smallest tables: against their SQL where there is one, else against brute force."""

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from scorewise.llm import language, mixing, queries
from scorewise.plans.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(entry.queries()) >= {*queries.QUERIES, "pipeline"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df, cursor = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    assert differences(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cursor.description], cursor.fetchall()) == []


def test_op3(spark, texts):
    want = dict(zip(texts, brute.substring_dedup(texts.values(), 35)))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op3_substring_dedup(spark, SF).collect()} == want


def test_op8(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in queries.op8_near_dedup(spark, SF).collect()}
    classes = dict(zip(texts, brute.near_classes(list(texts.values()), 0.8)))
    least = {}
    for key, c in classes.items():
        least[c] = min(least.get(c, key), key)
    assert got == {key: least[c] for key, c in classes.items()}


def test_op10(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = dict(zip(texts, brute.contamination(list(texts.values()), items)))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op10_decontaminate(spark, SF).collect()} == want


def test_held_out_columns(spark):
    rows = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    graded = queries.op9_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in graded)


def test_pipeline_stage_by_stage(spark, texts):
    """Each stage's decisions against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, frames = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = frames.columns
        frames = stage(spark, frames, SF)
        assert frames.columns == columns
        frames = spark.createDataFrame(frames.collect(), docs.schema)
        kept.append({r["doc_id"] for r in frames.collect()})
    told = language.predicted(docs, language.fit(docs)).filter(f"lang_pred <> 'und' and score >= {language.LEAST}")
    assert kept[0] == {r["doc_id"] for r in told.collect()} and len(kept[0]) >= 0.97 * len(texts)

    rows = sorted((key, texts[key]) for key in kept[0])
    assert kept[1] == {rows[i][0] for i, g in brute.exact_groups(rows).items() if g[2]}

    rows = sorted((key, texts[key]) for key in kept[1])
    first = {}
    for (key, _), c in zip(rows, brute.near_classes([t for _, t in rows], 0.8)):
        first.setdefault(c, key)
    assert kept[2] == set(first.values())

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted((key, texts[key]) for key in kept[2])
    assert kept[3] == {key for (key, _), c in zip(rows, brute.contamination([t for _, t in rows], items)) if not c[4]}

    copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(frames).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in corpus_pipeline.run(spark, SF).groupBy("doc_id").count().collect()} == copies


def test_pipeline_keeps_foreign_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in ("row", "_hash", "copies", "score")})
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.filter("_hash <> 'own _hash' or score <> 'own score'").isEmpty()
