import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomwork.functions import geometry
from loomwork.sources import convert, readers, sinks, tarshards
from loomwork.streaming import streams

SF = "/root/testdata/sf0.001"


def test_json_readers_and_mix(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "q": "x"}, {"id": 2, "q": "y"}]')
    (tmp_path / "b.jsonl").write_text('{"id": 3, "q": "z"}\n\nnot json\n{"id": 4}\n')
    good, bad = readers.json_records(spark, str(tmp_path / "a.json"), "id int, q string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (2, "y")] and bad.count() == 0
    good, bad = readers.json_records(spark, str(tmp_path / "b.jsonl"), "id int, q string")
    assert sorted(r["id"] for r in good.collect()) == [3, 4] and [r["value"] for r in bad.collect()] == ["not json"]
    mix = readers.mixed(spark, [{"name": "a", "annotation": str(tmp_path / "a.json"), "root": "/r"}, {"name": "b", "annotation": str(tmp_path / "b.jsonl")}], "id int, q string")
    assert sorted((r["id"], r["dataset_name"]) for r in mix.collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "b")]


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.traj").write_text("0.5 0 0 1.5707963267948966 1 2 3\nbad line\n1.0 0 0 0 0 0 0\n")
    rows = readers.trajectories(spark, str(tmp_path / "t.traj")).orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [0.5, 1.0] and np.allclose(rows[0]["pose"][:4], [0, -1, 0, 1]) and rows[1]["pose"][0] == 1.0
    (tmp_path / "c.pincam").write_text("640 480 500 501 320 240\n")
    r = readers.pinhole_cameras(spark, str(tmp_path / "c.pincam")).first()
    assert (r["width"], r["height"], r["k"][0], r["k"][5], r["k"][2]) == (640, 480, 500.0, 501.0, 320.0)
    (tmp_path / "v.txt").write_text("https://v\n" + "77 " + " ".join(map(str, range(18))) + "\nshort\n")
    r = readers.camera_tracks(spark, str(tmp_path / "v.txt")).collect()
    assert len(r) == 1 and (r[0]["url"], r[0]["ts"]) == ("https://v", 77) and r[0]["extrinsics"][-1] == 17.0
    (tmp_path / "m.txt").write_text("a.jpg\tq?\tYes\nbroken\n")
    assert [tuple(x) for x in readers.tab_lines(spark, str(tmp_path / "m.txt"), ["img", "question", "gt"]).collect()] == [("a.jpg", "q?", "Yes")]
    (tmp_path / "b.tsv").write_text("index\timage\tquestion\tA\tB\tC\n1\taGk=\tq\tx\ty\t\n")
    r = readers.benchmark_table(spark, str(tmp_path / "b.tsv")).first()
    assert r["options"] == {"A": "x", "B": "y"} and bytes(r["image"]) == b"hi" and r["hint"] is None


def test_folders_blobs_and_streams(spark, tmp_path):
    for s, n in (("s1", 3), ("s2", 1)):
        (tmp_path / "f" / s).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "f" / s / f"{i}.jpg").write_bytes(b"x")
    rows = readers.scene_folders(spark, str(tmp_path / "f"), "*.jpg", least=2).collect()
    assert [(r["scene"], len(r["frames"])) for r in rows] == [("s1", 3)]
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "a").write_text('{"question_type": 1}\n' * 3)
    (tmp_path / "blobs" / "b").write_text("xx" * 50)
    assert [r["role"] for r in readers.with_any_key(spark, str(tmp_path / "blobs"), ["bbox", "question_type"], 10, 10_000).collect()] == ["question_type"]
    table = pa.table({"a": [1, 2], "b": ["x", "y"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert sorted(tuple(r) for r in readers.arrow_streams(spark, str(tmp_path / "t.arrow"), "b string, a bigint").collect()) == [("x", 1), ("y", 2)]


def test_parquet_layout_manifest_and_cursor(spark, tmp_path):
    df = spark.range(1000).coalesce(1).withColumn("dataset_name", F.lit("d"))
    path = str(tmp_path / "out")
    sinks.write_samples(df, path, rows_per_file=400, rows_per_group=100)
    files = sorted(p for p in os.listdir(path) if p.endswith(".parquet"))
    meta = [pq.read_metadata(f"{path}/{p}") for p in files]
    assert [m.num_rows for m in meta] == [400, 400, 200] and meta[0].num_row_groups == 4
    assert sorted(r["num_rows"] for r in sinks.manifest_of(spark, path).collect()) == [200, 400, 400]
    listed = readers.parquet_files(spark, path)
    assert listed.count() == 3
    first = sorted(r["path"] for r in listed.collect())[0]
    assert readers.rows_from(spark, path, (first, 9)).count() == 990
    (tmp_path / "m.json").write_text(json.dumps({first: {"num_row_groups": 4, "num_rows": 400}}))
    units = readers.row_groups(readers.manifest(spark, str(tmp_path / "m.json")), listed)
    assert sorted(r["row_group"] for r in units.collect()) == [0, 1, 2, 3]
    assert readers.ranked_files(listed, 1, 2).count() == 1
    assert readers.prefix(df, ["id"], share=0.25).count() == 250
    sinks.write_samples(df, str(tmp_path / "by"), by_dataset=True)
    assert os.path.isdir(tmp_path / "by" / "dataset_name=d")


def test_tables_logs_and_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], bytearray(b"hi"))], "k int, l array<string>, b binary")
    sinks.write_tsv(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert "k\tl\tb" in text and "aGk=" in text
    assert df.select(sinks.quoted_list("l").alias("x")).first()["x"] == "['a', 'b']"
    for i in range(2):
        sinks.append_log(spark.createDataFrame([(i, "r")], "key int, result string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_lists(spark.createDataFrame([("train", "s1"), ("test", "s2")], "split string, scene string"), str(tmp_path / "l"), "split", "scene")
    assert sorted(p.name for p in (tmp_path / "l").iterdir() if p.is_dir()) == ["split=test", "split=train"]


def test_json_of_several_kinds_in_a_folder(spark, tmp_path):
    for name, text in {
        "a.json": ' \n[{"id": 1, "q": "x"}, {"id": 2, "q": "y"}]',
        "b.jsonl": '{"id": 3, "q": "z"}\n{"id": 4, "q": "u"}\nno json\n\n{"id": 5}\n',
        "c.json": '{\n  "id": 6,\n  "q": "v"\n}\n',
        "d.json": "",
        "e.json": '[{"id": 7',
    }.items():
        (tmp_path / name).write_text(text)
    good, bad = readers.json_records(spark, str(tmp_path), "id int, q string")
    assert sorted(r["id"] for r in good.collect() if r["id"] is not None) == [1, 2, 3, 4, 5, 6]
    assert "no json" in {r["value"] for r in bad.collect()}


def test_shards_of_a_second_write_follow_the_first(spark, tmp_path):
    path = str(tmp_path / "tars")
    for names in (("s1", "s2"), ("s3",)):
        rows = spark.createDataFrame([(n, "a", bytearray(b"x")) for n in names], "scene string, member string, content binary")
        tarshards.write_scenes(rows, path, max_scenes=1, partitions=2)
    assert {r["scene"] for r in spark.read.format("tarshards").option("path", path).load().collect()} == {"s1", "s2", "s3"}
    assert sorted(p.name for p in (tmp_path / "tars").glob("*.tar")) == ["shard-00000.tar", "shard-00001.tar", "shard-00002.tar"]


def test_tar_shards(spark, tmp_path):
    rows = [(f"s{i:02d}", f"c/{j}.txt", bytearray(f"{i}-{j}".encode())) for i in range(7) for j in range(3)]
    files = spark.createDataFrame(rows, "scene string, member string, content binary")
    path = str(tmp_path / "tars")
    new = tarshards.appended(spark, files.filter("scene < 's05'"), path, max_scenes=2, partitions=1)
    assert new.select("scene").distinct().count() == 5
    back = spark.read.format("tarshards").option("path", path).load()
    assert sorted((r["scene"], r["member"], bytes(r["content"])) for r in back.collect()) == sorted((a, b, bytes(c)) for a, b, c in rows if a < "s05")
    assert back.groupBy("shard").agg(F.count_distinct("scene").alias("n")).agg(F.max("n")).first()[0] == 2
    tarshards.appended(spark, files, path, max_scenes=2, partitions=1)
    back = spark.read.format("tarshards").option("path", path).load()
    assert back.count() == len(rows) and back.select("scene").distinct().count() == 7
    one = tarshards.shard_manifest(spark, path).collect()
    assert sorted(r["shard"] for r in one) == sorted(p.name for p in (tmp_path / "tars").glob("*.tar")) and sum(r["num_scenes"] for r in one) == 7
    for r in one:
        data = (tmp_path / "tars" / r["shard"]).read_bytes()
        assert (r["md5"], r["file_size_bytes"]) == (hashlib.md5(data).hexdigest(), len(data))
    assert all(len(r["md5"]) == 32 and r["num_scenes"] == len(r["scenes"]) <= 2 and r["file_size_bytes"] > 0 for r in one)


def test_converters(spark):
    kind = "id string, images array<string>, dataset_name string, extra int, conversations array<struct<`from`:string,`value`:string>>"
    df = spark.createDataFrame([("i", ["a", "b"], "d", 5, [("human", "q1"), ("gpt", "a1"), ("human", "q2"), ("gpt", "a2")])], kind)
    r = convert.REGISTRY["conversations"](df).first()
    assert (r["question"], r["answer"], len(r["poses"]), json.loads(r["metadata"])) == ("q2", "a2", 2, {"id": "i", "extra": 5})
    assert r["poses"][0] == df.select(geometry.identity().alias("v")).first()["v"]
    df = spark.createDataFrame([("", "q", None, "a", ["x"], "d")], "input_prompt string, question string, gt_answer string, answer string, images array<string>, dataset_name string")
    assert tuple(convert.REGISTRY["prompted"](df).select("question", "answer").first()) == ("q", "a")
    df = spark.createDataFrame([("q", ["x", "y"], "x", ["i"], "d")], "question string, options array<string>, answer string, images array<string>, dataset_name string")
    assert convert.REGISTRY["options"](df).first()["question"] == "q\nx\ny"
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert [one(convert.resolved(lit(p), lit("/root/"))) for p in ("a/b", "/a", "s3://x/y")] == ["/root/a/b", "/a", "s3://x/y"]
    assert one(convert.without_prefix(lit("data/x"))) == "x" and one(convert.first_word_in(lit("a/scannetpp/b"))) == "scannetpp" and one(convert.first_word_in(lit("zz"))) is None
    assert [one(convert.task_id(lit(t))) for t in ("caption", "zz")] == [1, 0] and one(convert.stem(lit("a/b.c.json"))) == "b.c"
    bad = [one(convert.valid_numbers(x)) for x in (F.array(lit(1.0)), F.array(lit(float("nan"))), F.array().cast("array<double>"), lit(None).cast("array<double>"), F.array(lit(float("-inf"))))]
    assert bad == [True, False, False, False, False]
    assert one(convert.valid_depth(lit(81.0), lit("street"), {"street": 80.0})) is False and one(convert.valid_depth(lit(81.0), lit("indoor"), {"street": 80.0})) is True
    text = json.dumps({"a": json.dumps({"b": json.dumps([1])}), "c": "3"})
    nested = spark.createDataFrame([(text,), ("x",), (None,)], "t string").select(convert.destringified("t").alias("v")).collect()
    assert json.loads(nested[0]["v"]) == {"a": {"b": [1]}, "c": "3"} and [r["v"] for r in nested[1:]] == ["x", None]
    kept, rejected = convert.split_rejects(spark.range(4), {"small": F.col("id") < 3, "even": F.col("id") % 2 == 0})
    assert kept.count() == 2 and {r["id"]: r["reason"] for r in rejected.collect()} == {1: "even", 3: "small"}


def test_streams_equal_tables(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = str(tmp_path / "src")
    events.repartition(3).write.parquet(src)
    stream = streams.files(spark, src, events.schema)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.withColumn("total", F.round("total", 4)).collect())
    got = streams.run_complete(streams.tumbling(stream, "1 day"), str(tmp_path / "days"), str(tmp_path / "c1"))
    assert key(got) == key(streams.tumbling(events, "1 day"))
    counts = streams.run_complete(streams.sessions(streams.files(spark, src, events.schema), "30 minutes", "1 minute"), str(tmp_path / "s"), str(tmp_path / "c2"))
    assert counts.count() == streams.sessions(events, "30 minutes").count()


def test_a_restart_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    spark.range(10).write.parquet(src)
    schema = spark.range(1).schema
    streams.run_once(streams.files(spark, src, schema), out, check)
    spark.range(10, 15).write.mode("append").parquet(src)
    streams.run_once(streams.files(spark, src, schema), out, check)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(15))


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.txt", "one")
        z.writestr("2.bin", "two")
    rows = readers.folder_or_zip(spark, str(tmp_path), r".*\.txt").collect()
    assert [(r["member"], bytes(r["content"])) for r in rows] == [("x/1.txt", b"one")]
    (tmp_path / "f.txt").write_text("plain")
    rows = readers.folder_or_zip(spark, str(tmp_path), r".*\.txt").collect()
    assert [(r["archive"], r["member"]) for r in rows] == [(None, "f.txt")]
