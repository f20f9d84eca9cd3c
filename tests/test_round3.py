"""Findings of a round: jobs that must not lean on small tables."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import parsers
from loomwork.operators import metrics, poses, prompts, sampling, similarity
from loomwork.plans import catalog
from loomwork.plans.tables import Tables
from loomwork.sources import readers, rowgroups
from loomwork.streaming import epochs

SF = "/root/testdata/sf0.001"


def test_a_track_is_read_in_splits(spark, tmp_path):
    numbers = " ".join(map(str, range(18)))
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text(f" https://{name}\n" + "".join(f"{i} {numbers}\n" if i % 5 else "short\n" for i in range(400)))
    small = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = readers.camera_tracks(spark, str(tmp_path / "*.txt")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["url"], r["pos"], r["ts"]) for r in rows) == [(f"https://{n}", i + 1, i) for n in "ab" for i in range(400) if i % 5]
    assert len({r["task"] for r in rows if r["url"] == "https://a"}) > 1


def test_scores_read_a_prediction_once(spark):
    assert str(metrics.vqa_accuracy(F.col("said"), F.col("answers"))).count("said") == 1
    assert str(metrics.anls(F.col("said"), F.col("answers"))).count("said") == 1
    rows = spark.createDataFrame([("The two cats!", ["2 cats", "2 cats", "dog", None]), (None, ["x"]), ("", [])], "said string, answers array<string>")
    got = [r[0] for r in rows.select(F.round(metrics.vqa_accuracy(F.col("said"), F.col("answers")), 6)).collect()]
    assert got == [round((2 * 1 / 3 + 2 * 2 / 3) / 4, 6), 0.0, 0.0]


def test_costly_rows_of_one_small_file_are_many_tasks(spark):
    assert Tables(spark, SF).spread("part", "p_partkey").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_the_normaliser_reads_its_text_once():
    assert str(parsers.evalai_answer(F.col("said"))).count("said") == 1


@pytest.mark.parametrize("name", ["scanqa_rows", "scene_bounds", "video3d_rows"])
def test_frames_of_six_digits_are_not_cut_to_others(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' UNION ALL SELECT 100000 + 10 * vec_id, embedding, label FROM '{SF}/embeddings.parquet' UNION ALL SELECT 10000 + vec_id, embedding, label FROM '{SF}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{SF}/conversations.parquet') TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    cursor = con.execute(catalog.oracle_sql()[name])
    columns, want = [c[0] for c in cursor.description], cursor.fetchall()
    number = lambda v: float(v) if isinstance(v, Decimal) else v
    plain = lambda rows: sorted(str([list(v) if isinstance(v, tuple) else number(v) for v in r]) for r in rows)
    got = catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert want and plain(got) == plain(want)


def test_named_listed_and_bare_scores(spark):
    rows = catalog.queries()["named_and_listed_scores"](spark, SF).filter("o_orderkey = 27").collect()
    assert [(list(r["listed"]), list(r["bare"])) for r in rows] == [([7.0, 4.0], [7.0])]


def test_blocks_of_poses_grow_with_their_scene(spark):
    n = [10, 100, 200, 10_000, 100_000]
    counts = spark.createDataFrame([(i,) for i in n], "n bigint").orderBy("n").select(poses.block_count(F.col("n"), 16)).collect()
    assert [r[0] for r in counts] == [1, 7, 8, 8, 49]
    eye = [float(i % 5 == 0) for i in range(16)]
    rows = spark.createDataFrame([(0, i, eye) for i in range(40)], "s int, f bigint, p array<double>")
    got = {(r["ref"], r["rank"]): r["id"] for r in poses.nearest_poses(rows, "s", "f", "p", 2, block=4).collect()}
    assert got == {(i, r): [j for j in range(40) if j != i][r - 1] for i in range(40) for r in (1, 2)}


def test_a_trigger_of_many_groups_is_few_tasks(spark, tmp_path):
    (tmp_path / "plan.json").write_text(str([["a.parquet", i] for i in range(100)]).replace("'", '"'))
    schema = spark.range(0).schema
    reader = epochs.EpochReader(schema, {"plan": str(tmp_path / "plan.json"), "seed": "1", "key": "id", "cursor": str(tmp_path / "at"), "tasks": "6"})
    runs = reader.partitions({"epoch": 0, "position": 30}, {"epoch": 1, "position": 40})
    groups = [(g.epoch, g.ordinal) for run in runs for g in run.groups]
    assert len(runs) == 6 and groups == [(0, i) for i in range(30, 100)] + [(1, i) for i in range(40)]


def test_open_answers_read_their_text_once():
    assert str(parsers.open_answer(F.col("said"))).count("said") == 1
    assert str(parsers.open_match(F.col("forms"), F.col("gold"))).count("gold") == 1


def test_a_split_hashes_its_cuts_once():
    assert str(sampling.decayed_split(F.col("total"), F.col("key"), 0.6)).count("sequence(") == 1


def test_token_counts_of_a_small_file_are_many_tasks(spark):
    assert catalog.queries()["image_token_counts"](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_prompts_that_ask_alike_meet_in_partial_sums(spark):
    rows = spark.createDataFrame([("t", 2, "p2", "x", "e2"), ("t", 1, "p1", "x", None), ("t", 3, "p3", "y", None)], "tag string, i bigint, prompt string, include string, exclude string")
    got = prompts.deduplicated(rows)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("t", "p1", "x", None), ("t", "p3", "y", None)]


def test_a_scene_lists_its_points_once_for_all_items(spark):
    found = catalog.queries()["video3d_rows"](spark, SF)
    assert "world_coords" not in found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert {r["points"] % 4 for r in found.collect()} == {0}


def test_an_archive_is_read_by_runs_of_members(spark, tmp_path):
    import zipfile

    kinds = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(40):
            z.writestr(f"d/{i}.{'txt' if i % 5 else 'bin'}", f"text {i} é" * i, compress_type=kinds[i % 4])
    found = readers.zip_members(spark, str(tmp_path), r".*\.txt", run=100).withColumn("task", F.spark_partition_id()).collect()
    assert {r["member"]: bytes(r["content"]).decode() for r in found} == {f"d/{i}.txt": f"text {i} é" * i for i in range(40) if i % 5}
    assert len(found) == 32 and len({r["task"] for r in found}) > 1


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_the_nearest_of_runs_are_those_of_all_pairs(metric):
    r = np.random.default_rng(3)
    v = np.tile(r.normal(size=(90, 5)), (4, 1))  # each vector four times
    v[7], v[50, 2] = 0, np.nan
    ids = np.arange(len(v)) * 3
    for k in (1, 3):
        q, d, far = similarity.nearest(v[:200], v, ids[:200], ids, k, metric)
        got = sorted(zip(q.tolist(), far.tolist(), d.tolist()))
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        want = []
        for i in range(200):
            each = 1 - unit @ unit[i] if metric == "cosine" else np.sqrt(((v - v[i]) ** 2).sum(1))
            pairs = sorted((e, j * 3) for j, e in enumerate(np.round(each, 9) + 0.0) if j != i and np.isfinite(e))
            want += [(i * 3, e, j) for e, j in pairs[:k]]
        assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want)]


def test_blocks_of_vectors_grow_with_their_table():
    assert [similarity._block_size(n, 4096) for n in (1000, 100_000, 10_000_000)] == [4096, 6250, 32_768]


def test_mutual_neighbours_are_looked_for_once(spark):
    plan = catalog.queries()["mutual_nn"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_a_scan_of_many_groups_is_few_tasks(spark, tmp_path):
    rowgroups.write_exact(spark.range(1000).withColumnRenamed("id", "k"), str(tmp_path), "x", ["k"], rows_per_file=100, rows_per_group=5)
    tasks = rowgroups.TASKS * spark.sparkContext.defaultParallelism
    found = rowgroups.scan(spark, str(tmp_path), "k bigint", after=(f"{tmp_path}/x_00000.parquet", 3, 2))
    assert found.rdd.getNumPartitions() == tasks < 200
    rows = found.collect()
    assert len(rows) == 1000 - 3 * 5 - 3 and len({r["k"] for r in rows}) == len(rows)
    assert [(r["global_row_group"], r["row_idx"]) for r in rows] == sorted((r["global_row_group"], r["row_idx"]) for r in rows)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from loomwork.plans import files

    rows = spark.createDataFrame([(i, "a b" if i % 2 else "x:y", None if i == 8 else f"{{\"bbox\":{i}}}\nrest") for i in range(900)], "id bigint, g string, value string")
    path = files._file_each(rows, f"file://{tmp_path}/f", "g", "id")
    found = readers.with_any_key(spark, f"{path}/g=*", ["bbox"], 0, 100)
    assert found.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    assert found.count() == 899 and (tmp_path / "f" / "g=x%3Ay" / "8.txt").read_text() == "\n"
    scenes = readers.scene_folders(spark, path, "*.txt", least=450, most=450)
    assert scenes.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism and scenes.count() == 2
    assert not list((tmp_path / "f").glob("**/_SUCCESS"))  # no job moves the files


def test_a_range_is_found_in_two_steps(spark):
    from loomwork.operators import ordering

    df = spark.createDataFrame([(i * 7 % 5000 if i % 97 else None,) for i in range(5000)], "v int")
    placed = ordering.in_ranges(df, "v")
    assert placed.columns == ["v", "_range"] and "_step" in placed._jdf.queryExecution().logical().toString()
    rows = sorted((-1 if r["v"] is None else r["v"], r["_range"]) for r in placed.collect())
    assert [r for _, r in rows] == sorted(r for _, r in rows) and len({r for _, r in rows}) > 200
    assert {r for v, r in rows if v == -1} == {-1} and ordering.in_ranges(df.filter("v is null"), "v").filter("_range = -1").count() == 52


def test_waiting_samples_share_entries_of_the_state():
    from loomwork.streaming import packing

    class State(dict):
        calls = 0

        def updateValue(self, k, v):
            self.calls, self[k] = self.calls + 1, v

        def getValue(self, k):
            self.calls += 1
            return self[k]

        def removeKey(self, k):
            self.calls += 1
            del self[k]

    state, ends, got = State(), {}, []
    for part in range(5):
        queue = packing.StateQueue("de", state, ends)
        for i in range(3000):
            queue.append((3000 * part + i, i))
        got += [queue.popleft()[0] for _ in range(1700)]
        queue.flush()
    got += [i for i, _ in packing.StateQueue("de", state, ends)]
    assert got == list(range(15_000)) and not state and state.calls < 150
