import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewise.llm import alignment, near


def partition(ids, classes):
    groups = {}
    for key, c in zip(ids, classes):
        groups.setdefault(c, set()).add(key)
    return {frozenset(g) for g in groups.values()}


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = draw.randrange(len(words)), draw.random()
        if kind < 0.6:
            words[at] = "new%d" % draw.randrange(10**6)
        elif kind < 0.8:
            del words[at]
        else:
            words.insert(at, "put%d" % draw.randrange(10**6))
    return words


def family(seed, sizes, length=120, rate=0.03):
    draw = random.Random(seed)
    rows = []
    for size in sizes:
        base = ["".join(draw.choices("abcdefghijk", k=4)) for _ in range(draw.randint(length // 2, length))]
        rows.append(" ".join(base))
        rows += [" ".join(edited(draw, base, max(1, int(rate * len(base))))) for _ in range(size - 1)]
    return list(enumerate(rows))


def test_alignment_matches_the_plain_distance():
    draw = np.random.default_rng(0)
    pairs = []
    for _ in range(300):
        a = draw.integers(0, 4, draw.integers(1, 60))
        b = a.copy()
        for _ in range(draw.integers(0, 14)):
            at = draw.integers(0, len(b) + 1)
            b = np.insert(b, at, 9) if draw.random() < 0.5 or not len(b) else np.delete(b, min(at, len(b) - 1))
        pairs.append((a.astype(np.int32), b.astype(np.int32)))
    for similarity in (0.5, 0.8, 0.95):
        want = [max(len(a), len(b)) == 0 or 1 - brute.distance(a.tolist(), b.tolist()) / max(len(a), len(b)) >= similarity - 1e-12 for a, b in pairs]
        for share in (1, 4, 12, 60):
            assert alignment.within(pairs, similarity, share).tolist() == want


def test_classes_match_all_pairs(spark):
    rows = family(1, [1, 2, 3, 8, 1, 1, 20, 2, 1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near.classes(df).collect()}
    ids = [i for i, _ in rows]
    assert partition(ids, [found[i] for i in ids]) == partition(ids, brute.near_classes([t for _, t in rows], near.SIMILARITY))


def test_texts_that_share_a_passage_only_stay_apart(spark):
    draw = random.Random(4)
    passage = " ".join("".join(draw.choices("abcdef", k=5)) for _ in range(60))
    rows = [(i, " ".join("".join(draw.choices("abcdef", k=5)) for _ in range(60)) + " " + passage) for i in range(150)]
    rows += [(1000 + i, t + " and") for i, t in rows[:40]]  # and each of these has one near copy
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near.classes(df).collect()}
    assert all(found[1000 + i] == i for i in range(40)) and len(set(found.values())) == 150


def test_order_counts():
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[30:] + words[:30])]
    import pyarrow as pa

    from scorewise.llm.words import slices

    (_, data, offsets), = slices(pa.array(texts))
    _, sketches = near.order_sketches(data, offsets, sketches=400)
    plain, _, edges, _ = near.labelled_shingles(data, offsets, near.K)
    shared = len(set(plain[: edges[1]].tolist()) & set(plain[edges[1] :].tolist()))
    jaccard = shared / (len(plain) - shared)
    agree = float((sketches[0] == sketches[1]).mean())
    # half of the pairs of shared shingles have changed their order
    assert jaccard > 0.8 and 0.3 < agree < 0.6


def test_components_of_long_paths(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z2", "z3"), ("z1", "z3")]
    labels = {r["node"]: r["label"] for r in near.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {labels[f"n{i:03}"] for i in range(61)} == {"n000"} and {labels["z1"], labels["z2"], labels["z3"]} == {"z1"}


def test_odd_rows(spark, docs, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = near.classes(docs).collect()
    assert len(found) == len(rows)
    named = {r["doc_id"]: r for r in found}
    assert named[2]["class_id"] == 1 and named[3]["class_id"] == 1 and named[4]["class_id"] == 1
    assert named[14]["class_id"] == named[14]["doc_id"] and named[5]["class_size"] == 2
    assert sum(r["kept"] for r in found) == len({r["class_id"] if r["class_id"] is not None else "none" for r in found})
    kept = near.without_near_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.filter("_hash <> 'own _hash'").isEmpty()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["kept"]}
    assert near.classes(empty).count() == 0 and near.without_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("copies", [400])
def test_a_hot_class(spark, copies):
    rows = [(i, t) for i, t in family(8, [copies, 1, 2], rate=0.02)]
    df = spark.createDataFrame(rows + [(10_000 + i, rows[0][1]) for i in range(copies)], "doc_id long, text string")
    sizes = {r["class_id"]: r["class_size"] for r in near.classes(df).select("class_id", "class_size").distinct().collect()}
    assert sizes[0] == 2 * copies and near.without_near_duplicates(df).agg(F.count("*")).first()[0] == 3


def spaced(draw, n, edits):
    """A text of n words and a copy with every (n / edits)-th word replaced."""
    base = ["".join(draw.choices("abcdefghijk", k=5)) for _ in range(n)]
    copy = list(base)
    for e in range(edits):
        copy[(2 * e + 1) * n // (2 * edits)] = "new%d" % draw.randrange(10**9)
    return " ".join(base), " ".join(copy)


@pytest.mark.parametrize("n, edits, least", [(5, 1, 1), (7, 1, 1), (9, 1, 1), (10, 2, 0.9), (14, 2, 0.95), (20, 4, 0.95), (100, 10, 0.99), (100, 15, 0.99), (100, 20, 0.97)])
def test_recall_down_to_the_threshold(spark, n, edits, least):
    draw = random.Random(n * 100 + edits)
    rows = []
    for i in range(200):
        a, b = spaced(draw, n, edits)
        rows += [(2 * i, a), (2 * i + 1, b)]
    found = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(200)) >= least * 200


def test_short_texts_match_all_pairs(spark):
    draw = random.Random(12)
    texts = sorted({" ".join(draw.choices("abcd", k=draw.randint(3, 9))) for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near.classes(df).collect()}
    ids = range(len(texts))
    assert partition(ids, [found[i] for i in ids]) == partition(ids, brute.near_classes(texts, near.SIMILARITY))


@pytest.mark.parametrize("edits, least", [(12, 0.95), (17, 0.9)])
def test_recall_in_crowded_buckets(spark, edits, least):
    """Pairs of texts of 100 words, of which all texts have 75 in common."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    common, rows = [word() for _ in range(75)], []
    for i in range(300):
        words = common + [word() for _ in range(25)]
        near_copy = list(words)
        for j in range(edits):
            near_copy[(j * 100) // edits] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near_copy))]
    found = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * i] == found[2 * i + 1] for i in range(300)) >= least * 300


def test_word_counts_bound_what_texts_share():
    import numpy as np
    import pyarrow as pa

    from scorewise.llm.words import slices

    draw = random.Random(8)
    texts = [" ".join(draw.choices(["a", "b", "c", "d", "e", "f", "g"], k=draw.randint(0, 40))) for _ in range(200)]
    (_, data, offsets), = slices(pa.array(texts))
    counts = near.word_counts(data, offsets)
    assert counts.sum(axis=1).tolist() == [len(t.split()) for t in texts]
    few = near.word_counts(data, offsets, 2)  # words that share a class only raise the bound
    for _ in range(300):
        i, j = draw.randrange(200), draw.randrange(200)
        a, b = texts[i].split(), texts[j].split()
        shared = sum(min(a.count(w), b.count(w)) for w in set(a))
        assert shared <= np.minimum(counts[i], counts[j]).sum() <= np.minimum(few[i], few[j]).sum()


def test_no_pair_at_the_threshold_is_lost(spark):
    rows = []
    for n, edits in ((10, 2), (14, 2), (20, 4), (25, 5)):
        draw = random.Random(n)
        for _ in range(300):
            rows += [(len(rows) + i, text) for i, text in enumerate(spaced(draw, n, edits))]
    found = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i + 1] == i for i in range(0, len(rows), 2))


def test_no_pair_of_a_crowd_is_lost(spark):
    """All texts have 75 of 100 words in common, near copies differ in another 17 to 20; classes are those of all pairs."""
    draw = random.Random(16)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    common, texts = [word() for _ in range(75)], []
    for i in range(60):
        words = common + [word() for _ in range(25)]
        near_copy = list(words)
        for j in range(17 + i % 4):
            near_copy[(j * 100) // (17 + i % 4)] = word()
        texts += [" ".join(words), " ".join(near_copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near.classes(df).collect()}
    assert partition(range(120), [found[i] for i in range(120)]) == partition(range(120), brute.near_classes(texts, near.SIMILARITY))


def test_similar_texts_list_a_common_shingle():
    import pyarrow as pa

    from scorewise.llm.words import slices

    draw = random.Random(3)
    steps = np.random.default_rng(3).integers(0, 50, near.SLOTS).astype(np.uint8)
    for _ in range(400):
        a = draw.choices("abcdefgh", k=draw.randint(2, 40))
        b = list(a)
        for _ in range(draw.randint(0, 8)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 1)] = draw.choices("xyab", k=draw.randint(0, 1))
        if len(b) < 2 or 1 - brute.distance(a, b) / max(len(a), len(b)) < near.SIMILARITY - 1e-12:
            continue
        (_, data, offsets), = slices(pa.array([" ".join(a), " ".join(b)]))
        listed, texts = near.prefixes(data, offsets, steps, near.SIMILARITY)
        assert set(listed[texts == 0].tolist()) & set(listed[texts == 1].tolist())


def test_similar_texts_share_as_many_listed_shingles_as_asked():
    import pyarrow as pa

    from scorewise.llm.words import slices

    draw = random.Random(5)
    steps = np.random.default_rng(5).integers(0, 50, near.SLOTS).astype(np.uint8)
    asked = 0
    for _ in range(200):
        a, b = spaced(draw, draw.randint(2, 300), 1)
        a, b = a.split(), edited(draw, b.split(), draw.randint(0, len(a) // 6))
        if 1 - brute.distance(a, b) / max(len(a), len(b)) < near.SIMILARITY - 1e-12 or len(b) < 2:
            continue
        (_, data, offsets), = slices(pa.array([" ".join(a), " ".join(b)]))
        listed, texts = near.prefixes(data, offsets, steps, near.SIMILARITY)
        least = near.commons(min(len(a), len(b)), near.SIMILARITY)
        asked = max(asked, least)
        assert len(set(listed[texts == 0].tolist()) & set(listed[texts == 1].tolist())) >= least
    assert asked > 5 and [near.commons(n, near.SIMILARITY) for n in range(2, 500)] == sorted(near.commons(n, near.SIMILARITY) for n in range(2, 500))


def test_alignment_of_long_pairs_visits_few_cells(monkeypatch):
    """A path that costs little enough settles a pair; a pair that shares too little is never aligned in a wide band."""
    draw, bands, banded = np.random.default_rng(2), [], alignment._banded
    monkeypatch.setattr(alignment, "_banded", lambda pairs, band, *more: bands.append(band) or banded(pairs, band, *more))
    a = draw.integers(0, 5000, 4000).astype(np.int32)
    near_copy, other = a.copy(), draw.permutation(a)
    near_copy[::25] = -7
    assert alignment.within([(a, near_copy), (a, other)], near.SIMILARITY).tolist() == [True, False]
    assert bands and max(bands) <= 4000 // 50


def test_slot_counts_leave_no_shuffle_and_few_bytes(spark, monkeypatch):
    import pyarrow as pa

    texts = [f"w{i} w{i + 1} w{i + 2}" for i in range(1000)]
    parts = list(near._slot_counts([pa.RecordBatch.from_pydict({"_text": pa.array(texts)})]))
    assert sum(len(p.column("counts")[0].as_py()) for p in parts) < 4 * near.SLOTS // 100
    names = []
    real = near.written
    monkeypatch.setattr(near, "written", lambda df, name: names.append(name) or real(df, name))
    steps = near.frequencies(spark.createDataFrame([(t,) for t in texts], "_text string"))
    assert names == ["near-steps"] and steps.sum() >= 1500 * 8 * 0.9


def crowd(draw, size):
    """Texts with 75 of 100 words in common, and of each a copy that differs in another 17 to 20."""
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    common, texts = [word() for _ in range(75)], []
    for i in range(size):
        words = common + [word() for _ in range(25)]
        near_copy = list(words)
        for j in range(17 + i % 4):
            near_copy[(j * 100) // (17 + i % 4)] = word()
        texts += [" ".join(words), " ".join(near_copy)]
    return texts


def test_a_crowd_makes_no_rows_of_pairs(spark, monkeypatch):
    """Texts that share most of their words meet in blocks: their pairs are no rows, however many blocks there are."""
    counts, real = {}, near.written

    def counted(df, name):
        table = real(df, name)
        counts[name] = counts.get(name, 0) + (table.count() if name in ("near-met", "near-blocks") else 0)
        return table

    monkeypatch.setattr(near, "written", counted)
    monkeypatch.setattr(near, "CROWD", 8)
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "COLUMNS", 50)
    texts = crowd(random.Random(21), 50)
    found = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert partition(range(100), [found[i] for i in range(100)]) == partition(range(100), brute.near_classes(texts, near.SIMILARITY))
    assert counts["near-met"] < 500 and counts["near-blocks"] > 2


def test_sets_weigh_what_two_texts_list_in_common():
    """Blocks of several parts and of numbers with gaps lose no common shingle, and invent none."""
    from collections import Counter

    import pyarrow as pa

    from scorewise.llm.words import slices

    texts = crowd(random.Random(22), 6)
    steps = np.random.default_rng(7).integers(0, 50, near.SLOTS).astype(np.uint8)
    (_, data, offsets), = slices(pa.array(texts))
    listed, owners = near.prefixes(data, offsets, steps, near.SIMILARITY)
    numbers = [3, 4, 5, 70_000, 70_001, 9, 10, 1 << 40, 20, 21, 22, 23]
    batch = pa.RecordBatch.from_pydict({"_text": pa.array(texts), "node": pa.array(numbers, pa.int64())})
    blocks = pa.Table.from_batches(near._listed(near.SIMILARITY, steps, 3)([batch])).sort_by("part").to_batches()
    sets, shared = {}, Counter()
    for i, some in enumerate(near._sets(blocks)):
        for r in some.to_pylist():
            sets.setdefault((r["set"], r["weight"], i), []).append(r["node"])
    for (_, weight, _), members in sets.items():
        shared.update({(a, b): weight for a in members for b in members if a < b})
    whole = [set(listed[owners == i].tolist()) for i in range(len(texts))]
    for i, a in enumerate(numbers):
        for j, b in enumerate(numbers):
            if a < b:
                assert shared[a, b] == len(whole[i] & whole[j])


def counted(monkeypatch):
    """Rows of each table that the operator writes."""
    counts, real = {}, near.written

    def count(df, name):
        table = real(df, name)
        counts[name] = counts.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(near, "written", count)
    return counts


def test_texts_that_share_shingles_by_chance_make_few_rows(spark, monkeypatch):
    """Two words follow each other in many unrelated texts; few of those could be near by the places of both."""
    draw = random.Random(31)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(120)], k=draw.randint(60, 600))) for _ in range(150)]
    texts += [" ".join(edited(draw, t.split(), len(t.split()) // 8)) for t in texts[:20]]
    counts = counted(monkeypatch)
    found = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[150 + i] == i for i in range(20)) and len(set(found.values())) == 150
    assert counts["near-sets"] < 4000  # 18,572 of the shingles that they list are in several texts


@pytest.mark.parametrize("crowd", [1, 64])
def test_meetings_are_those_of_the_lists_and_places(crowd):
    import pyarrow as pa

    from scorewise.llm.words import slices

    draw = random.Random(33)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(25)], k=draw.randint(20, 60))) for _ in range(60)]
    texts += [" ".join(edited(draw, t.split(), draw.randint(1, len(t.split()) // 6))) for t in texts[:30]]
    numbers, roots = list(range(5, 95)), [i if i % 3 else 5 for i in range(5, 95)]
    steps = np.random.default_rng(9).integers(0, 50, near.SLOTS).astype(np.uint8)
    (_, data, offsets), = slices(pa.array(texts))
    listed, owners, places, words = near._prefixes(data, offsets, steps, near.SIMILARITY)
    batch = pa.RecordBatch.from_pydict({"_text": pa.array(texts), "node": pa.array(numbers, pa.int64()), "root": pa.array(roots, pa.int64())})
    blocks = pa.Table.from_batches(near._listed(near.SIMILARITY, steps, 3)([batch])).sort_by("part").to_batches()
    rows = [r for some in near._meetings(near.SIMILARITY, crowd)(blocks) for r in some.to_pylist()]
    sets, shared = {}, {}
    for r in rows:
        if r["set"] is None:
            shared[r["a"], r["b"]] = shared.get((r["a"], r["b"]), 0) + 1
        else:
            sets.setdefault(r["set"], set()).add(r["a"])
    of = {}
    for s, t, p in zip(listed.tolist(), owners.tolist(), places.tolist()):
        of.setdefault(s, []).append((words[t], p, t))
    want, crowds = {}, set()
    for members in of.values():
        met = []
        for i, (n, p, a) in enumerate(members):
            for m, q, b in members[i + 1 :]:
                close = min(n, m) >= near.SIMILARITY * max(n, m) - 1e-9 and roots[a] != roots[b]
                most = int((1 - near.SIMILARITY) * max(n, m) + 1e-9)
                if close and (near.WILD in (p, q) or abs(p - q) + abs(n - p - m + q) <= most):
                    met.append((numbers[a], numbers[b]))
        if len(met) > crowd / 2 * len(members):
            crowds.add(frozenset(numbers[t] for _, _, t in members))
        else:
            for pair in met:
                want[pair] = want.get(pair, 0) + 1
    assert shared == want and {frozenset(s) for s in sets.values()} == crowds and (crowds or crowd > 1)
    for i in range(30):  # edits leave enough of the listed shingles where they may be
        a, b = texts[i].split(), texts[60 + i].split()
        if roots[i] != roots[60 + i] and 1 - brute.distance(a, b) / max(len(a), len(b)) >= near.SIMILARITY - 1e-12:
            inside = any({5 + i, 65 + i} <= s for s in crowds)
            assert inside or shared.get((5 + i, 65 + i), 0) >= near.commons(min(len(a), len(b)), near.SIMILARITY)


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_classes_do_not_depend_on_how_texts_are_sent(spark, monkeypatch, few):
    monkeypatch.setattr(near, "FEW", few)
    texts = [t for n, edits in ((12, 2), (30, 6), (100, 19)) for _ in range(20) for t in spaced(random.Random(n * edits + _), n, edits)]
    texts += [None, "", " \n ", texts[0], texts[0]]
    found = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[i + 1] == i for i in range(0, 120, 2)) and [found[i] for i in range(120, 125)] == [120, 120, 122, 0, 0]
