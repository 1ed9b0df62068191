"""Readers and writers on files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewise.sources import readers as R
from scorewise.sources import writers as W
from scorewise.sources.array_files import ArrayFiles, write_arrays
from scorewise.sources.json_arrays import read_json_array
from scorewise.sources.shared import written


def test_series_formats(spark, tmp_path):
    folder = tmp_path / "npy"
    folder.mkdir()
    np.save(folder / "01_0027_i3d.npy", np.array([0.1, 0.9], dtype="float32"))
    np.save(folder / "01_028.npy", np.array([0.5]))
    got = sorted((r.series_id, r.idx, round(r.score, 4)) for r in R.read_series(spark, str(folder), "npy").collect())
    assert got == [("01_0027", 0, 0.1), ("01_0027", 1, 0.9), ("01_028", 0, 0.5)]
    nested = str(tmp_path / "nested")
    spark.createDataFrame([(1, [0.2, 0.3])], "series_id long, scores array<double>").write.parquet(nested)
    assert sorted(map(tuple, R.read_series(spark, nested).collect())) == [(1, 0, 0.2), (1, 1, 0.3)]


def test_lists(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("a/b/01_0001 100 1 5 9\n\n  a/01_002\t50 0\n")
    got = sorted(tuple(r) for r in R.read_video_list(spark, str(path)).collect())
    assert got == [("01_0001", 100, 1), ("01_002", 50, 0)]
    path.write_text("a/01_0001/ x 100 1\na/01_002 x 50\n")
    assert [tuple(r) for r in R.read_video_list(spark, str(path), "train").collect()] == [("01_0001", 100, 1)]
    for layout, line in (("test", "a/b 10"), ("test", "a/b ten 1"), ("train", "a/b x ten 1")):
        path.write_text(line + "\n")
        with pytest.raises(Exception, match="malformed line"):
            R.read_video_list(spark, str(path), layout).collect()
    path.write_text("a/b/ 10 1\n")
    assert R.read_video_list(spark, str(path)).first().video_id == ""
    path.write_text("/x/01_0001_i3d.npy\n\n /x/02_003.npy \n")
    assert sorted(r.video_id for r in R.read_id_list(spark, str(path)).collect()) == ["01_0001", "02_003"]
    with pytest.raises(ValueError):
        R.read_video_list(spark, str(path), "other")


def test_annotations(spark, tmp_path):
    path = tmp_path / "ann.json"
    path.write_text(json.dumps([
        {"video_id": "a", "explanation": "x", "anomaly_start_frame": 1, "anomaly_end_frame": None},
        {"explanation": "no id"}, {"video_id": "b", "explanation": "  "},
    ]))
    assert sorted(r.video_id for r in R.read_annotations(spark, str(path)).collect()) == ["a", "b"]
    assert [r.video_id for r in R.read_annotations(spark, str(path), drop_blank=True).collect()] == ["a"]


def test_metadata_tree(spark, tmp_path):
    def put(name, meta):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps({"video_id": name, **meta}, indent=1))

    shot = {"snippet_idx": 1, "score": 0.5, "frame_num": 9}
    put("a", {"extracted_frames": [{**shot, "file": "f.jpg"}, {**shot, "file": None}], "anomalous_segments": [{"start": 1, "end": 2}]})
    put("b", {"extracted_frames": [{**shot, "file": "f.jpg"}], "anomalous_segments": [{"start_snippet": 3, "end_snippet": 4}]})
    put("c", {"extracted_frames": [shot]})
    got = {r.video_id: r for r in R.read_metadata_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and len(got["a"].extracted_frames) == 1
    assert [(s.start_snippet, s.end_snippet) for k in "ab" for s in got[k].anomalous_segments] == [(1, 2), (3, 4)]


def test_variant_outputs(spark, tmp_path):
    for name in ("01_0027_frames_only", "01_0027_frames_plus_score", "01_0028_other"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"video_id": name[:7], "explanation": name}))
    got = R.read_variant_outputs(spark, str(tmp_path), ["frames_only", "frames_plus_score"]).collect()
    assert sorted((r.video_id, r.variant) for r in got) == [("01_0027", "frames_only"), ("01_0027", "frames_plus_score")]


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifest")
    schema = "id string, video_id string, conversations array<struct<`from`:string,value:string>>, images array<string>, scores array<double>"
    df = spark.createDataFrame([("a_x", "a", [("human", "é"), ("assistant", "{}")], ["i.jpg"], [0.25])], schema)
    W.write_manifest(df, path)
    back = R.read_manifest(spark, path).first()
    assert back.conversations[0].value == "é" and back.scores == [0.25] and back.strategy is None


def test_rating_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    heads = [f"human_{c} (1-5)" for c in ("C", "S", "Co", "F")] + ["GPT_C_HIDE_until_done", "GPT_S_HIDE", "GPT_Co_HIDE", "GPT_F_HIDE"]
    path.write_text(",".join(heads) + "\n1,2,3,4,5,4,3,2\n1, ,3,4,5,4,3,2\n")
    got = R.read_rating_sheet(spark, str(path)).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 3.0, 4.0, 5.0, 4.0, 3.0, 2.0)]


def test_listing_and_inventory(spark, tmp_path):
    folder = tmp_path / "clip"
    folder.mkdir()
    for name in ("10.jpg", "2.jpg", "002.png", "b.JPG", "A.jpg", "notes.txt"):
        (folder / name).write_text("x")
    files = R.file_table(spark, str(tmp_path))
    got = [r.file for r in R.frame_listing(files).orderBy("pos").collect()]
    assert got == ["2.jpg", "002.png", "10.jpg", "A.jpg", "b.JPG"]
    kinds = {r.ext: (r.n, r.examples) for r in R.file_inventory(files).collect()}
    assert kinds[".jpg"] == (4, ["10.jpg", "2.jpg", "A.jpg"]) and kinds[".txt"] == (1, ["notes.txt"])


def test_reference_check(spark):
    child = spark.createDataFrame([("a",), ("b",), ("c",)], "image string")
    R.check_references(child, child, "image")
    with pytest.raises(ValueError, match="missing 2 references, first: \\['b', 'c'\\]"):
        R.check_references(child, child.filter("image = 'a'"), "image")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "video_id string, score double")
    for tag in ("x", "y"):
        total = W.write_report(df, str(tmp_path), tag, [F.avg("score").alias("mean")], "parquet").first()
        assert (total.n_videos, total["mean"], total.run_tag) == (2, 2.0, tag)
    assert spark.read.parquet(str(tmp_path / "per_video")).groupBy("run_tag").count().count() == 2


def test_written_table_is_fresh_each_time(spark):
    df = spark.range(5)
    a, b = written(df, "t"), written(df.filter("id < 2"), "t")
    assert (a.count(), b.count()) == (5, 2)


def test_the_last_annotation_of_an_id_counts(spark, tmp_path):
    entries = [{"video_id": "a", "explanation": str(i)} for i in range(5)] + [{"video_id": "b", "explanation": "one"}]
    path = tmp_path / "array.json"
    path.write_text(json.dumps(entries))
    assert sorted((r.video_id, r.explanation) for r in R.read_annotations(spark, str(path)).collect()) == [("a", "4"), ("b", "one")]
    path = tmp_path / "lines.json"
    path.write_text("\n".join(json.dumps(e) for e in entries))
    got = R.read_annotations(spark, str(path), lines=True).collect()
    assert sorted((r.video_id, r.explanation) for r in got) == [("a", "4"), ("b", "one")]


def entries_of(spark, path, size=None):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size)
    try:
        rows = read_json_array(spark, str(path))
        tasks = spark.read.text(str(path), lineSep="}").rdd.getNumPartitions()
        return [json.loads(r.value) for r in rows.orderBy("file", "pos").collect()], tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, indent):
    rng = random.Random(4)
    bits = ["plain", '"', "\\", "{", "}", "[", "]", ",", "}{", '\\"}', "\n", "é", ""]
    entries = [
        {"id": i, "text": "".join(rng.choices(bits, k=rng.randint(0, 12))), "deep": [{"a": [{}, {"}": rng.choice(bits)}]}] * rng.randint(0, 2)}
        for i in range(300)
    ]
    path = tmp_path / "array.json"
    path.write_text("  " + json.dumps(entries, indent=indent) + "\n")
    whole, one = entries_of(spark, path)
    split, many = entries_of(spark, path, 1500)
    assert whole == split == entries and one < 9 and many > 10


def test_array_edges(spark, tmp_path):
    for name, text, want in (
        ("empty", "[]", []), ("blank", " [ \n ] ", []), ("nothing", "", []), ("one", '[{"a": [1]}]', [{"a": [1]}]), ("bare", "[{},{}]", [{}, {}]),
    ):
        (tmp_path / name).write_text(text)
        assert entries_of(spark, tmp_path / name)[0] == want
        if name in ("one", "bare"):
            assert entries_of(spark, tmp_path / name, 2)[0] == want
    for text in ('[{"a": 1}', '[{"a": 1}, {"a"', '{"a": 1}', '[{"a": 1}] x', "[1, 2]", '[{"a": "}]'):
        (tmp_path / "broken").write_text(text)
        with pytest.raises(Exception, match="not an array of objects"):
            entries_of(spark, tmp_path / "broken")


def test_one_array_file_is_read_by_many_tasks(spark, tmp_path):
    values = np.arange(100_000, dtype="<f4").reshape(100, 1000)
    np.save(tmp_path / "a.npy", values)
    np.save(tmp_path / "b.npy", np.asfortranarray(values[:3, :4]))
    np.save(tmp_path / "c.npy", np.zeros(0))
    spark.dataSource.register(ArrayFiles)
    df = spark.read.format("npy").option("rangeBytes", 40_000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 11
    got = {name: sorted((r.idx, r.value) for r in df.filter(F.col("path").endswith(name)).collect()) for name in ("a.npy", "b.npy", "c.npy")}
    assert got["a.npy"] == [(i, float(i)) for i in range(100_000)] and got["c.npy"] == []
    assert got["b.npy"] == list(enumerate(values[:3, :4].reshape(-1).tolist()))
    np.save(tmp_path / "d.npy", np.array([{}]))
    with pytest.raises(Exception, match="objects are not read"):
        spark.read.format("npy").load(str(tmp_path)).collect()


def test_arrays_round_trip(spark, tmp_path):
    rows = [(s, i, i / 7 + s) for s in (1, 2, 3) for i in range(5000 * s)]
    df = spark.createDataFrame(rows, "series_id long, idx long, score double").repartition(7)
    for _ in range(2):  # a rerun changes nothing
        assert write_arrays(df, f"file://{tmp_path}/out") == 3
    assert np.load(tmp_path / "out" / "1.npy").tolist() == [r[2] for r in rows if r[0] == 1]
    got = R.read_series(spark, f"file://{tmp_path}/out", "npy").select(F.col("series_id").cast("long"), "idx", "score")
    assert sorted(map(tuple, got.collect())) == rows


def test_a_repeated_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "done")
    rows = spark.createDataFrame([(f"v{i}", i) for i in range(6)], "video_id string, n int")
    assert W.read_done(spark, path, rows.schema).count() == 0
    for _ in range(2):
        W.append_done(rows.filter("n < 4"), path, "a")
    W.append_done(rows.filter("n > 2"), path, "b")
    got = sorted((r.video_id, r.run) for r in W.read_done(spark, path).collect())
    assert got == [("v0", "a"), ("v1", "a"), ("v2", "a"), ("v3", "a"), ("v4", "b"), ("v5", "b")]
    broken = rows.select(F.concat("video_id", F.lit("x")).alias("video_id"), F.raise_error(F.lit("killed")).cast("int").alias("n"))
    with pytest.raises(Exception, match="killed"):
        W.append_done(broken, path, "c")
    assert sorted((r.video_id, r.run) for r in W.read_done(spark, path).collect()) == got


def test_references_raise(spark):
    child, parent = spark.range(10).toDF("k"), spark.range(7).toDF("k")
    with pytest.raises(ValueError, match="missing 3 references"):
        R.check_references(child, parent, "k")
    R.check_references(parent, child, "k")


def test_small_array_files_share_a_task(spark, tmp_path):
    for i in range(300):
        np.save(tmp_path / f"{i:03}.npy", np.arange(i % 7) + i / 1000)
    spark.dataSource.register(ArrayFiles)
    df = spark.read.format("npy").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    got = {}
    for r in df.collect():
        got.setdefault(int(r.path[-7:-4]), []).append((r.idx, r.value))
    assert got == {i: [(j, j + i / 1000) for j in range(i % 7)] for i in range(300) if i % 7}
