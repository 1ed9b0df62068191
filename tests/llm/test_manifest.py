"""The Merkle manifest against a plain recursion."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scorewise.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain(rows, fan=3):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""

    def tree(nodes):
        ways = [[] for _ in nodes]
        at, level = list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, i in enumerate(at):
                start = i - i % fan
                ways[k].append(("".join(level[start:i]), "".join(level[i + 1 : start + fan])))
                at[k] = i // fan
            level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
        return level[0], ways

    def leaf(key, text, lang, source, n):
        return h(*map(entry, (key, source, lang, n, text)))

    groups = {}
    for key, text, lang, source, n in rows:
        even = key is not None and zlib.crc32(str(key).encode()) % 2 == 0
        tampered = text.replace("\n", "") if text is not None and even else text
        groups.setdefault(source, []).append((key, leaf(key, text, lang, source, n), leaf(key, tampered, lang, source, n)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in groups[s]])
    root, tops = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (key, own, tried), way in zip(groups[s], trees[s][1]):
            node = tried
            for before, behind in way + top:
                node = h(before, node, behind)
            proof = h(*[a + z for a, z in way + top])
            out.append((key, own, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def rows_of(df, **options):
    found = manifest.manifest(df, candidate=manifest.leaf(text=manifest.without_line_feeds()), **options)
    return sorted((tuple(r) for r in manifest.verified(found).collect()), key=str)


def sample():
    rows = [(i, f"text {i}\nmore" if i % 3 else None, "en" if i % 2 else None, f"s{i % 4 if i % 7 else 9}", i) for i in range(90)]
    rows += [(1000 + i, "x\n", "en", None, None) for i in range(4)] + [(7, "é\n", "fr", "é", 2), (7, "é\n", "fr", "é", 2), (None, "n", "en", "s1", 1)]
    return rows


@pytest.mark.parametrize("fan, depth", [(3, 5), (3, 1), (3, 2), (2, 1), (4, 2)])
def test_like_a_plain_recursion(spark, fan, depth):
    from conftest import DOCS

    rows = sample()
    got = rows_of(spark.createDataFrame(rows, DOCS), fan=fan, depth=depth)
    assert got == plain(rows, fan)
    assert {r[-1] for r in got} == {True, False}


def test_edge_cases(spark, docs, clashing, empty):
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(docs) == plain(rows)
    assert rows_of(clashing) == plain(rows)
    assert rows_of(empty) == []
    one = docs.filter("doc_id = 9")
    assert rows_of(one) == plain([tuple(r) for r in one.collect()])


def test_tampering_shows(spark, docs):
    found = manifest.manifest(docs, candidate=manifest.leaf(text=F.concat(F.coalesce("text", F.lit("")), F.lit("."))))
    assert manifest.verified(found).filter("verified").isEmpty()
    assert manifest.verified(manifest.manifest(docs)).filter("not verified").isEmpty()


def test_proofs_are_siblings(spark, docs):
    """The segments suffice to find the root without any other row."""
    for r in manifest.manifest(docs, depth=1).collect():
        node = r.leaf
        for s in r.segments:
            node = h(s.before, node, s.behind)
        assert node == r.root


def test_tables_of_blocks_hold_no_proofs_and_small_row_groups(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    tables, real = {}, manifest.written
    monkeypatch.setattr(manifest, "written", lambda df, name, *more: tables.setdefault(name, real(df, name, *more)))
    monkeypatch.setattr(manifest, "GROUP_BYTES", 1 << 20)
    rows = spark.range(120_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    assert manifest.verified(manifest.manifest(rows)).filter("not verified").isEmpty()
    for name in ("manifest-rows", "manifest-blocks"):
        assert "segments" not in tables[name].columns
        groups = [g for f in glob.glob(f"{tables[name].written_to.removeprefix('file:')}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
        assert groups and max(g.num_rows for g in groups) <= 200
