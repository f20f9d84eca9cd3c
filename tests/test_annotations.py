"""Mixes, records and converters of annotation files, on odd files and records."""

import json

from pyspark.sql import functions as F

from loomwork.sources import annotations as A

TURNS = [{"from": "human", "value": "q1"}, {"from": "gpt", "value": "a1"}, {"from": "human", "value": "q2"}]


def write(path, records, array=False):
    path.write_text(json.dumps(records, indent=1) if array else "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def records(spark, path, name="scannet_x", root="/r", repeat=1):
    return A.mixed_records(spark, [{"name": name, "annotation": path, "root": root, "repeat": repeat}])


def test_lines_arrays_and_repeats(spark, tmp_path):
    lines = write(tmp_path / "a.jsonl", [{"k": i} for i in range(7)] + ["", "   ", "no json"])
    got = A.lines_of(spark, lines).orderBy("line").collect()
    assert [r["line"] for r in got] == list(range(8)) and got[7]["value"] == "no json"
    array = write(tmp_path / "b.json", [{"k": [1, 2]}, {"k": None}], array=True)
    assert [r["value"] for r in A.lines_of(spark, array).orderBy("line").collect()] == ['{"k":[1,2]}', '{"k":null}']
    assert [records(spark, lines, repeat=x).count() for x in (3, 0.5, 2.0, 0)] == [24, 4, 8, 0]
    both = str(tmp_path)
    assert A.lines_of(spark, both).groupBy("file").count().count() == 2
    assert A.mixed_records(spark, []).count() == 0


def test_mix_files(spark, tmp_path):
    path = tmp_path / "mix.json"
    path.write_text(json.dumps({"raw_qa_a": {"annotation": "x/a.jsonl", "root": "/abs", "repeat_time": 2}, "b": {"annotation": "s3://y", "root": "r"}}, indent=2))
    mix = A.mix_of(spark, str(path), base="/base/")
    assert [(d["annotation"], d["root"], d["repeat"]) for d in mix] == [("/base/x/a.jsonl", "/abs", 2), ("s3://y", "/base/r", 1)]
    assert [d["name"] for d in A.mix_of(spark, str(path), only="raw_qa")] == ["raw_qa_a"]


def test_rejects_by_reason(spark, tmp_path):
    items = ["{", "[1]", {"id": 1}, {"id": 2, "image": []}, {"id": 3, "image": ["a"] * 5}, {"id": 4, "image": "one.jpg", "conversations": TURNS, "extra": json.dumps({"x": json.dumps([1])})}, {"id": 5, "image": ["a"], "conversations": "odd"}]
    path = write(tmp_path / "a.jsonl", items)
    good, bad = A.samples(records(spark, path), "spar")
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "malformed", "no images", "no images", "too many images"]
    rows = {json.loads(r["metadata"])["id"]: r for r in good.collect()}
    assert (rows[4]["question"], rows[4]["answer"], rows[4]["image_path"], rows[4]["scene_name"]) == ("q2", "a1", ["/r/one.jpg"], "scannet")
    assert json.loads(rows[4]["metadata"]) == {"type": "unknown", "id": 4, "extra": {"x": [1]}} and rows[4]["poses"] is None
    assert (rows[5]["question"], rows[5]["answer"]) == ("", "")
    none, lost = A.samples(records(spark, path, name="elsewhere"), "spar")
    assert none.count() == 0 and {r["reason"] for r in lost.collect()} == {"malformed", "no images", "no scene"}
    told = {(r["dataset_name"], r["reason"]): r["n"] for r in A.counts(good, bad).collect()}
    assert told["spar_scannet_x", None] == 2 and told["scannet_x", "no images"] == 2


def test_files_that_exist_and_fallbacks(spark, tmp_path):
    files = spark.createDataFrame([("/r/data/a.jpg",), ("/r/b.jpg",), ("/r/b.jpg",), ("/abs/c.jpg",)], "path string")
    items = [{"idx": 1, "image_input": ["data/a.jpg", "data/b.jpg", "data/gone.jpg", "/abs/c.jpg"], "mindcube_input": "q", "text_output": "a", "k": 1}, {"idx": 2, "image_input": "data/gone.jpg"}, {"idx": 1, "image_input": ["data/b.jpg"]}]
    good, bad = A.samples(records(spark, write(tmp_path / "a.jsonl", items), name="t"), "3dthinker", files)
    rows = sorted(good.collect(), key=lambda r: r["line"])
    assert [r["image_path"] for r in rows] == [["/r/data/a.jpg", "/r/b.jpg", "/abs/c.jpg"], ["/r/b.jpg"]]
    assert json.loads(rows[0]["metadata"]) == {"type": "3dthinker", "id": 1, "k": 1} and len(rows[0]["poses"]) == 3
    assert [r["reason"] for r in bad.collect()] == ["no file"]


def test_repeated_lines_stay(spark, tmp_path):
    files = spark.createDataFrame([("/r/1.jpg",)], "path string")
    path = write(tmp_path / "a.jsonl", [{"id": 1, "images": ["1.jpg"], "question": "q", "gt_answer": "a"}] * 2)
    good, _ = A.samples(records(spark, path, repeat=2), "mindcube", files)
    assert good.count() == 4 and {tuple(r["image_path"]) for r in good.collect()} == {("/r/1.jpg",)}


def test_frames_of_a_folder(spark, tmp_path):
    files = spark.createDataFrame([(f"/r/f/v/{n}",) for n in ("2.png", "1.JPG", "x.txt")] + [("/r/w/1.jpg",)], "path string")
    items = [{"id": "a", "video": "v", "data_path": "f", "conversations": TURNS}, {"id": "b", "video": "w"}, {"id": "c", "video": "gone"}, {"id": "d", "images": ["llava_hound/frames/w/1.jpg"], "video": "v"}]
    good, bad = A.samples(records(spark, write(tmp_path / "a.jsonl", items)), "vgllm_llava_hound", files)
    rows = {json.loads(r["metadata"])["id"]: r["image_path"] for r in good.collect()}
    assert rows == {"a": ["/r/f/v/1.JPG", "/r/f/v/2.png"], "b": ["/r/w/1.jpg"], "d": ["/r/w/1.jpg"]}
    assert [r["reason"] for r in bad.collect()] == ["no images"]


def test_every_kind_takes_an_empty_record(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [{}])
    for name in A.KINDS:
        good, bad = A.samples(records(spark, path), name)
        assert good.count() == 0 and [r["reason"] for r in bad.collect()] == ["no images"]
        assert A.samples(records(spark, path).limit(0), name)[0].columns == [*A.SAMPLE, "source", "line"]


def test_folders(spark):
    folders = spark.createDataFrame([("s1", ["/d/s1/1.png", "/d/s1/2.png"]), ("s2", ["/d/s2/1.png"]), ("s3", ["x"] * 9)], "scene string, frames array<string>")
    good, bad = A.folder_samples(folders, "re10k", most=5)
    row = good.first()
    assert row["image_path"] == ["s1/1.png", "s1/2.png"] and json.loads(row["metadata"]) == {"type": "re10k", "id": "s1", "n_frames": 2}
    assert {r["scene"]: r["reason"] for r in bad.collect()} == {"s2": "too few images", "s3": "too many images"}
    assert good.select(F.size("poses")).first()[0] == 2
