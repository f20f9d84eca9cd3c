"""What is written, read back by row groups, streamed and kept: layouts, cursors, restarts and failed runs."""

import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwork.operators.binning import Budget, packed
from loomwork.sources import rowgroups, tarshards
from loomwork.streaming import epochs, packing, streams, versions


def names(rows, column="path"):
    return sorted(r[column].rsplit("/", 1)[-1] for r in rows.collect())


def laid_out(spark, path, n=95, rows_per_file=40, rows_per_group=10, **more):
    df = spark.range(n).withColumn("text", F.concat(F.lit("t"), "id"))
    rowgroups.write_exact(df, path, "part", ["id"], rows_per_file=rows_per_file, rows_per_group=rows_per_group, **more)
    return df


# --- row groups


def test_exact_layout_and_footers(spark, tmp_path):
    path = str(tmp_path / "x")
    laid_out(spark, path)
    meta = [pq.read_metadata(f"{path}/part_0000{i}.parquet") for i in range(3)]
    assert [m.num_rows for m in meta] == [40, 40, 15]
    assert [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in meta] == [[10] * 4, [10] * 4, [10, 5]]
    found = rowgroups.footers(rowgroups.listing(spark, path))
    assert sorted((r["path"][-12:], r["row_group"], r["first_row"], r["num_rows"]) for r in found.collect())[-1] == ("0002.parquet", 1, 10, 5)
    known = rowgroups.existing_manifest(spark, path)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, rowgroups.manifest_of(found).collect()))


def test_manifests_of_one_object_or_several(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"a": {"num_row_groups": 1, "num_rows": 3}, "b": {"num_row_groups": 2, "num_rows": 9}}, indent=2))
    assert sorted(map(tuple, rowgroups.read_manifest(spark, str(tmp_path / "one.json")).collect())) == [("a", 1, 3), ("b", 2, 9)]
    rowgroups.write_manifest(rowgroups.read_manifest(spark, str(tmp_path / "one.json")).coalesce(1), str(tmp_path / "more"))
    assert sorted(map(tuple, rowgroups.read_manifest(spark, str(tmp_path / "more")).collect())) == [("a", 1, 3), ("b", 2, 9)]


def test_ranks_cover_every_group_once_and_a_cursor_resumes(spark, tmp_path):
    path = str(tmp_path / "x")
    laid_out(spark, path)
    parts = [rowgroups.scan(spark, path, "id bigint", seed=4, rank=r, world=3) for r in range(3)]
    assert sorted(r["id"] for p in parts for r in p.collect()) == list(range(95))
    rows = [tuple(r) for r in parts[1].select("global_row_group", "row_idx", "file", "row_group", "id").collect()]
    rows.sort()
    at = rows[len(rows) // 2]
    rest = rowgroups.scan(spark, path, "id bigint", seed=4, rank=1, world=3, after=(at[2], at[3], at[1]))
    assert sorted(r["id"] for r in rest.collect()) == sorted(r[4] for r in rows if r > at)
    with pytest.raises(ValueError, match="no group"):
        rowgroups.scan(spark, path, "id bigint", after=(f"{path}/part_00009.parquet", 0, 0))


def test_files_that_cannot_be_read_or_are_not_known(spark, tmp_path):
    path = str(tmp_path / "x")
    df = laid_out(spark, path)
    (tmp_path / "x" / "bad.parquet").write_bytes(b"nothing")
    df.coalesce(1).write.mode("append").parquet(path)
    known = rowgroups.existing_manifest(spark, path)
    unknown = names(rowgroups.not_in_manifest(rowgroups.listing(spark, path), known))
    assert len(unknown) == 2 and "bad.parquet" in unknown
    told = rowgroups.footers(rowgroups.listing(spark, path)).filter("error is not null").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in told] == ["bad.parquet"]
    assert rowgroups.scan(spark, path, "id bigint").count() == 95
    (tmp_path / "x" / "part_00001.parquet").write_bytes(b"nothing")
    assert rowgroups.scan(spark, path, "id bigint").count() == 55
    with pytest.raises(Exception, match="(?i)parquet|magic"):
        rowgroups.scan(spark, path, "id bigint", errors="raise").count()


def test_first_rows_open_no_group_behind_them(spark, tmp_path):
    path = str(tmp_path / "x")
    laid_out(spark, path)
    groups = rowgroups.footers(rowgroups.listing(spark, path)).persist()
    groups.count()
    (tmp_path / "x" / "part_00002.parquet").write_bytes(b"gone")
    order = {r["id"]: (r["file"], r["row_idx"], r["row_group"]) for r in rowgroups.scan(spark, path, "id bigint").collect()}
    in_order = sorted(order, key=lambda i: (order[i][0], order[i][2], order[i][1]))
    for n in (0, 1, 10, 37, 60):
        rows, told = rowgroups.first_rows(spark, groups, "id bigint", n)
        assert sorted(r["id"] for r in rows.collect()) == sorted(in_order[:n])
        assert told["groups"] == -(-n // 10) and told["rows"] == 10 * told["groups"]
    rows, told = rowgroups.first_rows(spark, groups, "id bigint", 20, F.when(F.col("id") > 50, F.lit(None)).otherwise(F.col("id") % 3 == 0))
    want = [i for i in in_order if i <= 50 and i % 3 == 0]
    assert sorted(r["id"] for r in rows.collect()) == sorted(want[:20])
    everything, _ = rowgroups.first_rows(spark, groups, "id bigint", 1000)
    assert everything.count() == 80  # what can still be read


def test_a_run_that_breaks_off_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "x")
    laid_out(spark, path, n=40)
    bad = spark.range(100).withColumn("text", F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.lit("t")))
    with pytest.raises(Exception, match="stop"):
        rowgroups.resume_exact(bad, path, "part", ["id"], rows_per_file=40, rows_per_group=10)
    assert names(rowgroups.existing_manifest(spark, path)) == ["part_00000.parquet"]
    rowgroups.resume_exact(spark.range(100).withColumn("text", F.lit("t")), path, "part", ["id"], rows_per_file=40, rows_per_group=10)
    assert names(rowgroups.existing_manifest(spark, path)) == [f"part_0000{i}.parquet" for i in range(3)]
    assert sorted(r["id"] for r in rowgroups.scan(spark, path, "id bigint").collect()) == list(range(100))


def test_an_empty_table_and_an_empty_folder(spark, tmp_path):
    path = str(tmp_path / "x")
    laid_out(spark, path, n=0)
    assert rowgroups.existing_manifest(spark, path) is None
    (tmp_path / "y").mkdir()
    assert rowgroups.scan(spark, str(tmp_path / "y"), "id bigint").count() == 0
    assert rowgroups.read_groups(spark, [], "id bigint").columns == ["id", "file", "row_group", "row_idx", "global_row_group"]


# --- epochs


def test_epochs_resume_and_never_end(spark, tmp_path):
    path = str(tmp_path / "x")
    laid_out(spark, path)
    known = rowgroups.existing_manifest(spark, path)

    def stream(last=None, seed=1):
        return epochs.epochs(spark, known, "id bigint, text string", "id", f"{path}-c/at.json", seed=seed, groups_per_trigger=4, last=last)

    out, check = f"{path}-out", f"{path}-check"
    assert epochs.run_epochs(stream(), out, check, rows=10**9, triggers=7) == 7  # 28 of endless groups, 10 an epoch
    rows = spark.read.parquet(out)
    counts = {r["epoch"]: r["n"] for r in rows.groupBy("epoch").agg(F.count_distinct("global_row_group").alias("n")).collect()}
    assert counts == {0: 10, 1: 10, 2: 8}
    by = {e: [r["id"] for r in rows.filter(F.col("epoch") == e).orderBy("global_row_group", "pos").collect()] for e in (0, 1)}
    assert sorted(by[0]) == sorted(by[1]) == list(range(95)) and by[0] != by[1]
    assert rows.count() == rows.select("epoch", "id").distinct().count()


# --- latest values


def batch(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, at int")


def values(spark, path):
    return {r["k"]: r["v"] for r in versions.latest(spark, path, "k string, v int, at int").collect()}


def test_latest_values_of_a_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for rows in ([("a", 1, 1), ("b", 2, 1), ("n", None, 5)], [("a", 5, 2), ("b", 0, 0), ("n", 1, 4)]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(src)
        versions.keep_latest(streams.files(spark, src, batch(spark, []).schema), out, check, ["k"], "v", "at")
    assert values(spark, out) == {"a": 5, "b": 2, "n": 1}


def test_a_batch_touches_its_buckets_only_and_replays_do_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    assert values(spark, out) == {}
    versions.merge(batch(spark, [(f"k{i}", i, 0) for i in range(200)]), 0, out, ["k"], "v", "at", buckets=32)
    _, before = versions.pointer(out)
    touched = versions.merge(batch(spark, [("k7", -7, 1)]), 1, out, ["k"], "v", "at", buckets=32)
    _, after = versions.pointer(out)
    assert len(touched) == 1 and [b for b in after if after[b] != before.get(b)] == touched
    assert versions.merge(batch(spark, [("k7", 99, 9)]), 1, out, ["k"], "v", "at", buckets=32) == []
    assert values(spark, out)["k7"] == -7 and len(values(spark, out)) == 200


def test_killed_between_write_and_pointer(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t")
    versions.merge(batch(spark, [("a", 1, 1), ("b", 1, 1)]), 0, out, ["k"], "v", "at", buckets=4)
    with monkeypatch.context() as m:
        m.setattr(versions, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            versions.merge(batch(spark, [("a", 2, 2), ("c", 2, 2)]), 1, out, ["k"], "v", "at", buckets=4)
    assert values(spark, out) == {"a": 1, "b": 1}
    versions.merge(batch(spark, [("a", 2, 2), ("c", 2, 2)]), 1, out, ["k"], "v", "at", buckets=4)
    assert values(spark, out) == {"a": 2, "b": 1, "c": 2}
    versions.merge(batch(spark, [("a", 3, 3)]), 7, out, ["k"], "v", "at", buckets=4)  # numbers may have gaps
    assert values(spark, out) == {"a": 3, "b": 1, "c": 2}
    assert versions.vacuum(out, pointers=1) >= 1
    assert values(spark, out) == {"a": 3, "b": 1, "c": 2}


# --- packing


def streamed(spark, tmp_path, rows, budget, mandatory=(), parts=3):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    kind = "shard int, rn bigint, id bigint, tokens bigint, grp string, last boolean"
    cut = -(-len(rows) // parts)
    with packing.with_state_store(spark):
        for part in range(parts + 1):
            some = [(*r, False) for r in rows[cut * part : cut * part + cut]] if part < parts else [(s, None, None, None, None, True) for s in sorted({r[0] for r in rows})]
            spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(src)
            streams.run_once(packing.packed(streams.files(spark, src, spark.read.parquet(src).schema), budget, mandatory), out, check)
    return spark.read.parquet(out)


def places(df):
    return sorted(tuple(map(str, r)) for r in df.select("shard", "id", "state", "bin", "pos", "start", "tokens").collect())


@pytest.mark.parametrize("budget", [Budget(100, 90, 80), Budget(100, 90, 80, buffer=3, prefer_below=50), Budget(100, 90, 80, carry=True)])
def test_packing_a_stream_is_packing_the_table(spark, tmp_path, budget):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, 10_000 + i, int(rng.integers(1, 90)), None) for i in range(120)]
    want = packed(spark.createDataFrame(rows, "shard int, rn bigint, id bigint, tokens bigint, grp string"), budget)
    assert places(streamed(spark, tmp_path, rows, budget)) == places(want)


def test_a_rare_mandatory_group_waits_in_the_state_store(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(0, i, i, int(rng.integers(1, 70)), "rare" if i in (55, 80, 81, 100) else "b" if i % 4 == 0 else None) for i in range(110)]
    budget = Budget(100, 90, 80)
    want = packed(spark.createDataFrame(rows, "shard int, rn bigint, id bigint, tokens bigint, grp string"), budget, ("rare", "b"))
    got = streamed(spark, tmp_path, rows, budget, ("rare", "b"))
    assert places(got) == places(want)
    assert {r["state"] for r in got.collect()} >= {"packed", "waiting"} and got.count() == 110


def test_held_samples_are_given_out_when_no_more_come(spark, tmp_path):
    import time

    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    rows = [(0, i, i, 40 + i, None, False) for i in range(6)]
    spark.createDataFrame(rows, packing.SAMPLES).coalesce(1).write.parquet(src)
    with packing.with_state_store(spark):
        stream = packing.packed(streams.files(spark, src, spark.read.parquet(src).schema), Budget(100, 90, 80, buffer=3, prefer_below=10), linger=200)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="200 milliseconds").start()
        try:
            found = {}
            for _ in range(120):
                time.sleep(0.5)
                if query.exception() is not None:
                    raise query.exception()
                if query.lastProgress and query.lastProgress["batchId"] > 0:
                    found = {r["id"]: r["state"] for r in spark.read.schema(stream.schema).parquet(out).collect()}
                    if len(found) == 6:
                        break
        finally:
            query.stop()
    assert found == {0: "packed", 1: "packed", 2: "waiting", 3: "waiting", 4: "waiting", 5: "dropped"}


# --- tar shards and their log


def scene_rows(spark, scenes):
    return spark.createDataFrame([(s, "a.txt", bytearray(s.encode())) for s in scenes], "scene string, member string, content binary")


def test_a_shard_without_a_log_line_is_not_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tarshards.appended(spark, scene_rows(spark, ["s1", "s2"]), path, max_scenes=1, partitions=1)
    (tmp_path / "t" / "shard-00002.tar").write_bytes(b"half a shard of a killed run")
    tarshards.register(spark)
    read = lambda: spark.read.format("tarshards").option("path", path).load()
    assert sorted(r["scene"] for r in read().collect()) == ["s1", "s2"]
    new = tarshards.appended(spark, scene_rows(spark, ["s1", "s2", "s3"]), path, max_scenes=1, partitions=1)
    assert [(r["scene"], r["shard"]) for r in new.collect()] == [("s3", "shard-00002.tar")]
    assert sorted(r["scene"] for r in read().collect()) == ["s1", "s2", "s3"]
    assert tarshards.appended(spark, scene_rows(spark, ["s1"]), path, max_scenes=1, partitions=1).count() == 0


def test_a_failed_write_leaves_the_log(spark, tmp_path):
    path = str(tmp_path / "t")
    tarshards.appended(spark, scene_rows(spark, ["s1"]), path, max_scenes=1, partitions=1)

    def broken(batches):
        for b in batches:
            yield b.slice(0, 1)
            raise ValueError("lost")

    rows = scene_rows(spark, ["s2", "s3"]).coalesce(1)
    tarshards.register(spark)
    with pytest.raises(Exception, match="lost"):
        rows.mapInArrow(broken, rows.schema).write.format("tarshards").option("path", path).option("max_scenes", 1).mode("append").save()
    assert [r["scene"] for r in tarshards.progress(spark, path).collect()] == ["s1"]
    tarshards.appended(spark, scene_rows(spark, ["s1", "s2", "s3"]), path, max_scenes=2, partitions=1)
    assert sorted((r["scene"], r["shard"]) for r in tarshards.progress(spark, path).collect()) == [("s1", "shard-00000.tar"), ("s2", "shard-00001.tar"), ("s3", "shard-00001.tar")]


# --- numbers in any order


@pytest.mark.parametrize("ranges,bound", [(256, 8192), (3, 10)])
def test_numbers_in_any_order_equal_one_window(spark, monkeypatch, ranges, bound):
    from pyspark.sql import Window

    from loomwork.operators import ordering

    monkeypatch.setattr(ordering, "RANGES", ranges)
    monkeypatch.setattr(ordering, "BOUND_ROWS", bound)
    rng = np.random.default_rng(1)
    rows = [(int(g), None if rng.random() < 0.1 else f"k{rng.integers(40):02d}", i) for i, g in enumerate(rng.integers(0, 3, 400))]
    df = spark.createDataFrame(rows, "g int, k string, i long")
    for within in ([], ["g"]):
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy(*within).orderBy("k", "i")))
        got = ordering.numbered_by(df, ["k", "i"], within)
        assert got.columns == ["g", "k", "i", "rn"] and sorted(r["rn"] for r in got.collect()) == sorted(r["rn"] for r in want.collect())
        assert {(r["i"], r["rn"]) for r in got.collect()} == {(r["i"], r["rn"]) for r in want.collect()}
    stamps = spark.range(50).withColumn("d", F.expr("date_add(date'2024-01-01', int(id * 7 % 50))"))
    assert [r["id"] * 7 % 50 + 1 for r in ordering.numbered_by(stamps, ["d"]).orderBy("rn").collect()] == list(range(1, 51))
    assert ordering.numbered_by(df.limit(0), ["k"]).count() == 0


def test_first_lines_of_blobs(spark, tmp_path):
    from loomwork.sources import readers

    (tmp_path / "a").write_bytes(b'{"x": 1}\n' + b"\xff" * 100_000)
    (tmp_path / "b").write_bytes(b'{"y": 1, "long": "' + b"z" * 70_000 + b'"}\nrest')
    (tmp_path / "c").write_bytes(b'{"x": null}')
    (tmp_path / "d").write_bytes(b"q" * 300_000)
    found = {r["path"][-1]: r["role"] for r in readers.with_any_key(spark, str(tmp_path), ["x", "y"], 5, 200_000).collect()}
    assert found == {"a": "x", "b": "y"}
    assert {r["path"][-1] for r in readers.with_any_key(spark, str(tmp_path), ["x", "y"], 5, 200_000, head=50_000).collect()} == {"a"}
