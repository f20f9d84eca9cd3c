"""Reports, captions, prefixes, pickles and report files on odd rows."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import joins, metrics
from loomwork.sources import readers, sinks


def test_pairs_with_other_answers(spark):
    rows = [("t", 1, "yes", "Yes"), ("t", 1, "no", "no"), ("t", 2, "YES", "perhaps"), ("t", 2, "no", "yes"), ("t", 3, "yes", None), ("u", 1, "no", "other"), ("gone", 1, "yes", "yes")]
    df = spark.createDataFrame(rows, "task string, image int, g string, p string")
    got = {(r["type"], r["task"]): r for r in metrics.paired_report(df, "task", "image", F.col("g"), F.col("p"), {"A": ["t", "u"], "B": ["none"]}).collect()}
    t = got["A", "t"]
    assert [t[c] for c in ("TP", "FN", "FP", "TN", "other_num")] == [1, 0, 1, 1, 2]
    assert (t["precision"], t["recall"], t["acc"], t["acc_plus"]) == (0.5, 1.0, 0.4, 1 / 3)
    u = got["A", "u"]
    assert (u["precision"], u["recall"], u["acc"], u["score"]) == (0.0, 0.0, 0.0, 0.0)
    assert set(got) == {("A", "t"), ("A", "u"), ("A", None)} and got["A", None]["score"] == pytest.approx(t["score"])


def test_domains_without_rows(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("z", True)], "cat string, ok boolean")
    got = {r["name"]: (r["level"], r["num"], r["acc"]) for r in metrics.domain_report(df, "cat", F.col("ok"), {"D": ["a", "b", "c"], "E": ["f"]}).collect()}
    assert got == {"a": ("category", 2, 0.5), "b": ("category", 1, 1.0), "Overall-D": ("domain", 3, 0.667), "Overall-E": ("domain", 0, 0.0), "Overall": ("all", 3, 0.667)}


def test_best_first(spark):
    df = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 0.9), ("g", "c", None), ("g", "d", 0.5)], "g string, v string, acc double")
    assert [r["v"] for r in metrics.best_first(df, "g", "acc", ["v"]).orderBy("place").collect()] == ["b", "a", "d", "c"]


def test_repeated_right_keys_do_not_repeat_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("a", 5), (None, 7)], "r string, v int")
    got = {r["i"]: r["v"] for r in joins.with_default(left, right, ["k"], "r", "v", F.lit(0)).collect()}
    assert got == {1: 5, 2: 0, 3: 0}


def test_captions(spark):
    rows = [(1, '{"a": "x"}'), (2, "{}"), (3, "no json"), (4, None), (5, '{"a": null, "b": "y"}'), (6, '{"a": "p", "b": "q"}')]
    got = {r["k"]: r["caption"] for r in readers.captioned(spark.createDataFrame(rows, "k int, c string"), "c", "k", 1).collect()}
    assert {k: got[k] for k in range(1, 6)} == {1: "x", 2: " ", 3: " ", 4: " ", 5: "y"} and got[6] in "pq"


def test_shuffled_prefixes_are_nested(spark):
    df = spark.range(300)
    few, more = (sorted(r["id"] for r in readers.shuffled_prefix(df, ["id"], 3, n=n).collect()) for n in (10, 50))
    assert len(few) == 10 and set(few) < set(more) and few != list(range(10))
    assert readers.shuffled_prefix(df, ["id"], 3, share=0.1).count() == 30 and readers.shuffled_prefix(df.limit(0), ["id"], 3, n=5).count() == 0


def test_ranks_are_all_files(spark):
    files = spark.createDataFrame([(f"f{i:02d}",) for i in range(10)], "path string")
    parts = [sorted(r["path"] for r in readers.ranked_files(files, k, 4).collect()) for k in range(4)]
    assert [len(p) for p in parts] == [3, 3, 3, 1] and sum(parts, []) == [f"f{i:02d}" for i in range(10)]


def test_pickled_scenes(spark, tmp_path):
    scene = {"sample_idx": "scannet/a", "axis_align_matrix": np.eye(2), "n": np.float32(0.5), "images": [{"img_path": "x.jpg"}]}
    (tmp_path / "a.pkl").write_bytes(pickle.dumps({"data_list": [scene, {"sample_idx": "b"}]}))
    rows = readers.pickled_scenes(spark, str(tmp_path / "a.pkl")).select(F.from_json("value", "sample_idx string, axis_align_matrix array<array<double>>, n double, images array<struct<img_path:string>>").alias("v")).select("v.*").collect()
    assert [r["sample_idx"] for r in rows] == ["scannet/a", "b"] and rows[0]["axis_align_matrix"] == [[1.0, 0.0], [0.0, 1.0]] and rows[0]["n"] == 0.5
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps({"data_list": [pytest.approx(1)]}))
    with pytest.raises(Exception, match="plain value"):
        readers.pickled_scenes(spark, str(tmp_path / "bad.pkl")).count()


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5, ["x"]), ("a", None, [])], "k string, v double, l array<string>")
    for kind, want in (("csv", ["k,v,l", "a,,[]"]), ("txt", ["k: a, v: , l: []"]), ("json", ['{"k":"a","v":null,"l":"[]"}'])):
        sinks.write_report(df, str(tmp_path / kind), kind, ["k"])
        files = [p for p in (tmp_path / kind).iterdir() if p.name.startswith("part-")]
        assert len(files) == 1 and files[0].read_text().splitlines()[: len(want)] == want
    with pytest.raises(ValueError, match="xml"):
        sinks.write_report(df, str(tmp_path / "z"), "xml")


def test_area_under_the_recall_of_errors(spark):
    rng = np.random.default_rng(5)
    errors = np.round(rng.exponential(4, 500), 2)
    rows = [("g", float(e)) for e in errors] + [("g", None)] * 20 + [("h", 50.0), ("n", None)]
    got = {r["g"]: r["auc"] for r in metrics.error_auc(spark.createDataFrame(rows, "g string, e double"), "g", "e", 10.0).collect()}
    e = np.sort(np.r_[errors, np.full(20, np.inf)])
    recall = np.r_[0, (np.arange(len(e)) + 1) / len(e)]
    e = np.r_[0, e]
    last = np.searchsorted(e, 10.0)
    want = np.trapezoid(np.r_[recall[:last], recall[last - 1]], np.r_[e[:last], 10.0]) / 10
    assert got["g"] == pytest.approx(want) and got["h"] == 0.0 and got["n"] == 0.0
