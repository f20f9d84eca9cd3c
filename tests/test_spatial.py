"""Poses, scenes, sequence plans, masks and judges' texts against plain Python."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import judges, parsers, vision
from loomwork.operators import poses, prompts, scenes, sequences


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


# --- poses


def random_poses(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        pose = np.eye(4)
        pose[:3, :3], pose[:3, 3] = q, rng.normal(size=3) * 3
        out.append(pose)
    return out


def brute_distances(ps):
    scale = np.mean([np.linalg.norm(p[:3, 3]) for p in ps]) or 1.0
    far = np.empty((len(ps), len(ps)))
    for i, a in enumerate(ps):
        for j, b in enumerate(ps):
            trace = np.trace(a[:3, :3].T @ b[:3, :3])
            far[i, j] = math.degrees(math.acos(max(-1, min(1, (trace - 1) / 2)))) / 180 + np.linalg.norm(a[:3, 3] - b[:3, 3]) / scale
    return far


def framed(spark, by_scene):
    rows = [(s, i, [float(x) for x in p.ravel()]) for s, ps in by_scene.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "scene string, frame long, pose array<double>")


def test_nearest_poses_in_blocks_equal_brute_force(spark):
    by = {"a": random_poses(23, 1), "b": random_poses(7, 2), "one": random_poses(1, 3)}
    by["still"] = [np.eye(4)] * 3  # no movement at all: ties, the lower frame first
    got = poses.nearest_poses(framed(spark, by), "scene", "frame", "pose", 4, block=5)
    found = {(r["scene"], r["ref"], r["rank"]): (r["id"], r["distance"]) for r in got.collect()}
    assert len(found) == 23 * 4 + 7 * 4 + 3 * 2
    for s in ("a", "b"):
        far = np.round(brute_distances(by[s]), 9)
        np.fill_diagonal(far, np.inf)
        for ref in range(len(far)):
            order = np.argsort(far[ref], kind="stable")[:4]
            assert [found[s, ref, k + 1][0] for k in range(4)] == list(order)
            assert np.allclose([found[s, ref, k + 1][1] for k in range(4)], far[ref][order])
    assert [found["still", r, k][0] for r in range(3) for k in (1, 2)] == [1, 2, 0, 2, 0, 1]


def test_samples_near_a_reference(spark):
    by = {"a": random_poses(30, 4), "two": random_poses(2, 5)}
    rows = poses.near_pose_sample(framed(spark, by), "scene", "frame", "pose", 6, 0.75, 1).orderBy("scene", "place").collect()
    frames = {s: [r["frame"] for r in rows if r["scene"] == s] for s in by}
    assert all(len(v) == 6 for v in frames.values())
    far = brute_distances(by["a"])[frames["a"][0]]
    far[frames["a"][0]] = -1
    assert set(frames["a"]) <= set(np.argsort(far, kind="stable")[:9]) and set(frames["two"]) <= {0, 1}
    capped = poses.near_pose_sample(framed(spark, by), "scene", "frame", "pose", 6, 0.75, 1, most=1)
    assert capped.select("scene", "frame").distinct().count() == 2


# --- scenes


def test_matrix_product_paths_and_empty_bounds(spark):
    a, b = random_poses(2, 6)
    lit = lambda m: F.array(*[F.lit(float(x)) for x in m.ravel()])
    got = spark.range(1).select(scenes.product(lit(a), lit(b)).alias("v")).first()["v"]
    assert np.allclose(np.array(got).reshape(4, 4), a @ b)
    path = lambda x, s=None: spark.range(1).select(scenes.frame_path(F.lit(x), "/r/", s).alias("v")).first()["v"]
    assert path("scannet/scene1/00001.jpg") == "/r/scene1/00001.jpg" and path("x/scannet/scannet/1.jpg", ".png") == "/r/x/scannet/1.png" and path("plain.jpg") == "/r/plain.jpg"
    flat = spark.createDataFrame([("v", 0, 1, 1, False, [1.0, 2.0, 3.0])], "video_id string, frame int, u int, v int, valid boolean, point array<double>")
    assert scenes.bounds(flat).first()["boundary"] == [0.0] * 6


# --- sequence plans


def test_plan_of_one_sample(spark):
    rows = [
        (1, 0, "text", 5, None, False, False, None, None),
        (1, 1, "vit_image", 0, (1, 4, 8), False, False, None, None),
        (1, 2, "vit_image", 0, (1, 4, 8), False, True, None, None),
        (1, 3, "vae_image", 0, (1, 2, 2), False, False, 7, 10),
        (1, 4, "vae_image", 0, (1, 2, 2), False, False, 7, 13),
        (1, 5, "vae_image", 0, (1, 2, 2), False, False, 8, 20),
        (1, 6, "text", 3, None, True, False, None, None),
        (1, 7, "text", 9, None, True, True, None, None),
    ]
    got = sequences.plan(spark.createDataFrame(rows, sequences.SEGMENTS)).orderBy("seg").collect()
    assert [r["tokens"] for r in got] == [5, 10, 0, 3, 3, 3, 4, 0]
    assert [r["start"] for r in got] == [0, 5, 15, 15, 18, 21, 24, 28]
    assert [r["advance"] for r in got] == [5, 6, 1, 3, 3, 3, 4, 0]
    assert [r["position"] for r in got] == [0, 5, 11, 12, 15, 18, 21, 25]
    assert [r["split"] for r in got] == [0, 1, 2, 3, 3, 4, 5, 6]
    assert [r["frame_delta"] for r in got] == [None, None, None, 3, None, None, None, None]
    assert [(r["split_start"], r["split_end"]) for r in got][3:6] == [(True, False), (False, True), (True, True)]
    assert [r["split_tokens"] for r in got][3:5] == [6, 6] and {r["mode"] for r in got if r["kind"] == "text"} == {"causal"}


# --- masks


def noise(key, *parts):
    return int(hashlib.md5(":".join(map(str, (key, *parts))).encode()).hexdigest()[:6], 16)


def brute_walk(h, w, key, share):
    target = min(max(1, round(h * w * share)), h * w) if share > 0 else 0
    queue = [noise(key, "start") % (h * w)]
    for t in range(target):
        y, x = divmod(queue[t], w)
        for _, i in sorted((noise(key, t, i), i) for i in range(4)):
            dy, dx = ((1, 0), (-1, 0), (0, 1), (0, -1))[i]
            cell = (y + dy) * w + x + dx
            if 0 <= y + dy < h and 0 <= x + dx < w and cell not in queue:
                queue.append(cell)
    return [k in queue[:target] for k in range(h * w)]


def brute_blob(h, w, key, share, smooth):
    raw = np.array([[noise(key, y, x) for x in range(w)] for y in range(h)])
    size = min(smooth, h, w)
    reach = (size + 1 - size % 2) // 2
    wide = np.pad(raw, reach, mode="symmetric")
    total = np.array([[wide[y : y + 2 * reach + 1, x : x + 2 * reach + 1].sum() for x in range(w)] for y in range(h)])
    target = min(max(1, round(h * w * share)), h * w)
    return list((total >= np.sort(total.ravel())[-target]).ravel())


@pytest.mark.parametrize("h,w,share", [(1, 1, 0.5), (1, 7, 0.3), (6, 5, 0.4), (9, 12, 0.55), (4, 4, 1.0), (5, 5, 0.0)])
def test_walk_and_blob_masks(spark, h, w, share):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    for key in ("a", "b"):
        assert one(vision.walk_cells(F.lit(h), F.lit(w), F.lit(key), share)) == brute_walk(h, w, key, share)
        if share > 0:
            for smooth in (10, 3):
                assert one(vision.blob_cells(F.lit(h), F.lit(w), F.lit(key), share, smooth)) == brute_blob(h, w, key, share, smooth)


# --- prompts


def test_prompt_rules(spark):
    nouns = ["person", "apple", "bench"]
    rows = prompts.suite(spark, nouns, 60, 3, most=10).collect()
    for r in rows:
        things = json.loads(r["include"])
        if r["tag"] in ("colors", "color_attr"):
            assert "person" not in {x["class"] for x in things} and len({x["color"] for x in things}) == len(things)
        if r["tag"] in ("two_object", "position", "color_attr"):
            assert things[0]["class"] != things[1]["class"]
        if r["tag"] == "position":
            assert things[1]["target"] == 0 and "position" not in things[0]
        if r["tag"] == "counting":
            n = things[0]["count"]
            assert json.loads(r["exclude"]) == [{"class": things[0]["class"], "count": n + 1}] and f" {prompts.COUNTS[n]} " in r["prompt"]
        else:
            assert r["exclude"] is None
    assert {json.loads(r["include"])[0]["count"] for r in rows if r["tag"] == "counting"} >= {2, 9, 10}
    with pytest.raises(ValueError, match="counts"):
        prompts.suite(spark, nouns, 1, 3, most=11)
    with pytest.raises(ValueError, match="two nouns"):
        prompts.suite(spark, ["person", "apple"], 1, 3)


# --- judges


def test_balanced_objects(spark):
    cases = {'a {"b": {"c": "}"}} d {}': '{"b": {"c": "}"}}', "{}": "{}", "} {1} ": "{1}", "{": None, "": None, "it's \" {x}": "{x}", '{"a\\"}": 1}': '{"a\\"}": 1}', None: None}
    assert values(spark, judges.balanced_object, cases) == list(cases.values())


def test_repairs(spark):
    cases = {
        '{"a": [1, 2,],}': '{"a": [1, 2]}',
        "{a: 1, b_c : [2]}": '{"a": 1, "b_c" : [2]}',
        '{"a": "say "x" now"}': '{"a": "say \\"x\\" now"}',
        '{"a": "fine: \\"x\\""}': '{"a": "fine: \\"x\\""}',
        "nothing {": None,
    }
    assert values(spark, judges.repaired_json, cases) == list(cases.values())


def test_dual_scores_with_reasons(spark):
    texts = ['{"instruction_score": 3, "knowledge_score": "x"}', 'so: {"knowledge_score": 4.0, "knowledge_reasoning": "ok"} end', 'Instruction Score: 5, "knowledge_reasoning": " it "', "{}", None]
    got = [tuple(r) for r in values(spark, judges.dual_scores, texts)]
    assert got == [(3, None, None, None), (0, None, 4, "ok"), (5, None, None, "it"), (None,) * 4, (None,) * 4]


def test_numbers_as_python_reads_and_writes_them(spark):
    texts = ["3d", "3D", "1f", "1e5", "1,000", "nan", " 12.5\n", "1_0", "1__0", "0x1", "-inf", "5.", ".5", ".", "", "+7", " 8 ", "--1", "1e", "1e400", "1e-7", "123456789.25", "-0.0"]

    def python(t):
        try:
            return float(t)
        except ValueError:
            return None

    want = [python(t) for t in texts]
    assert list(map(str, values(spark, parsers.number_of, texts))) == list(map(str, want))
    assert values(spark, lambda t: parsers.number_text(parsers.number_of(t)), texts) == [None if x is None else str(x) for x in want]
    assert values(spark, parsers.strip, ["\t a ", "\x1fb\x85", None]) == ["a", "b", None]


def test_line_feeds_and_units_in_answers(spark):
    from loomwork.operators import metrics

    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert one(metrics.exact_match(lit("yes\n"), F.array(lit("yes"))))
    assert one(metrics.anls(lit("cat\t\n"), F.array(lit("Cat")))) == 1.0
    assert one(metrics.relaxed_match(lit("3d"), lit("3"))) is False and one(metrics.relaxed_match(lit(" 3\n"), lit("3.1"))) is True
    choices = F.array(lit("red"), lit("blue"))
    assert one(parsers.normalised_answer(lit("B\n"), choices, lit("multi_choice"), lit("text"), lit(1))) == "blue"
    assert one(parsers.normal_forms(lit("3D"))) == ["3d"] and one(parsers.normal_forms(lit("1,250.125\n"))) == ["#1250.12"]
    assert one(parsers.quick_extract(lit("2d"), choices, lit("free_form"), lit("float"))) == "2d"
    assert one(parsers.is_float_string(lit("3.5d"))) is False
    assert "5" in "".join(one(parsers.open_answer(lit("x = 5\n")))) and one(parsers.open_match(parsers.open_answer(lit("x = 5\n")), F.array(lit("5")))) is True
    assert one(parsers.open_match(F.array(lit("#NaN")), F.array(lit("nan")))) is False
