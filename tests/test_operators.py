import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import geometry as G
from loomwork.functions import vision as V
from loomwork.operators import binning, conversations, joins, metrics, ordering, sampling, similarity, windows

SF = "/root/testdata/sf0.001"


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


# --- packing


def brute_pack(samples, budget):
    """The plain loop: (state, bin, start) by id."""
    out, curr, count, b = {}, 0, 0, 0
    held, queue = [], list(samples)
    while queue or (held and curr < budget.prefer_below):
        if held and curr < budget.prefer_below:
            (i, n), buffered = held.pop(0), True
        else:
            (i, n), buffered = queue.pop(0), False
        if n > budget.per_sample:
            out[i] = ("too_long", None, None)
            continue
        if curr + n > budget.most:
            if len(held) < budget.buffer and not buffered:
                held.append((i, n))
            else:
                out[i] = ("dropped", None, None)
                b, curr, count = b + (count > 0), 0, 0
            continue
        out[i] = ("packed", b, curr)
        curr, count = curr + n, count + 1
        if curr >= budget.expected:
            b, curr, count = b + 1, 0, 0
    for i, _ in held:
        out[i] = ("waiting", None, None)
    return out


@pytest.mark.parametrize("budget", [binning.Budget(100, 90, 80), binning.Budget(100, 80, 100, buffer=3, prefer_below=50)])
def test_packing_is_the_plain_loop(spark, budget):
    rng = np.random.default_rng(0)
    rows = [(s, r, 1000 * s + r, int(rng.integers(1, 110))) for s in range(3) for r in range(200)]
    df = spark.createDataFrame(rows, "shard int, rn int, id long, tokens long")
    got = {r["id"]: r for r in binning.packed(df, budget).collect()}
    assert len(got) == len(rows)
    for s in range(3):
        want = brute_pack([(i, n) for sh, _, i, n in rows if sh == s], budget)
        for i, (state, b, start) in want.items():
            if state != "waiting" and got[i]["state"] != "waiting":
                assert (got[i]["state"], got[i]["bin"], got[i]["start"]) == (state, b, start)
    full = {}
    for r in got.values():
        if r["state"] == "packed":
            full[(r["shard"], r["bin"])] = full.get((r["shard"], r["bin"]), 0) + r["tokens"]
    assert max(full.values()) <= budget.most


def test_mandatory_groups_begin_bins(spark):
    rows = [(0, r, r, 10 + r % 7, "m" if r % 3 == 0 else "x") for r in range(90)]
    df = spark.createDataFrame(rows, "shard int, rn int, id long, tokens long, grp string")
    group = {r[2]: r[4] for r in rows}
    got = binning.packed(df, binning.Budget(60, 50, 40), mandatory=("m",)).collect()
    assert len(got) == 90
    firsts = [group[r["id"]] for r in got if r["state"] == "packed" and r["pos"] == 0]
    assert firsts and set(firsts) == {"m"}


def test_carry_keeps_the_sample_that_closes_a_bin(spark):
    df = spark.createDataFrame([(0, i, i, 60) for i in range(4)], "shard int, rn int, id long, tokens long")
    dropped = binning.packed(df, binning.Budget(100, 90, 80)).filter("state = 'dropped'").count()
    assert dropped == 2
    assert binning.packed(df, binning.Budget(100, 90, 80, carry=True)).filter("state = 'packed'").count() == 4


# --- sampling


@pytest.mark.parametrize("how", ["floor", "stride", "balanced", "ceil"])
def test_shards_are_disjoint(spark, how):
    df = spark.range(103).withColumnRenamed("id", "k")
    rows = sampling.shards(df, "k", 1, 8, how).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    want = {"floor": [12] * 8, "stride": [13] * 7 + [12], "balanced": [13] * 7 + [12], "ceil": [13] * 7 + [12]}[how]
    assert sizes == want and len({r["k"] for r in rows}) == len(rows)
    assert [r["rn"] for r in sorted(rows, key=lambda r: r["rn"])] == list(range(1, len(rows) + 1))


def test_numbering_matches_a_sort(spark):
    import hashlib

    df = spark.range(500).withColumn("g", F.col("id") % 3).withColumn("k", ordering.order_key(5, "id"))
    got = {r["id"]: r["rn"] for r in ordering.numbered(df, "k", ["id"], ["g"]).collect()}
    for g in range(3):
        ids = sorted((i for i in range(500) if i % 3 == g), key=lambda i: hashlib.md5(f"{i}:5".encode()).hexdigest())
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_repeat_variants(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)], "g string, i int")
    count = lambda r, v: sampling.repeated(df, "g", "i", F.lit(r), v).count()
    assert [count(r, "a") for r in (2.0, 0.35, 1.5, 1.0)] == [20, 3, 10, 10]
    assert [count(r, "b") for r in (2.0, 0.35, 1.5)] == [20, 3, 15]
    assert count(3.0, "c") == 30
    with pytest.raises(Exception, match="whole number"):
        count(1.5, "c")


def test_even_chunks(spark):
    df = spark.createDataFrame([(0, i, 10 - i) for i in range(8)] + [(1, i, i) for i in range(5)], "m int, i int, n int")
    rows = sampling.even_chunks(df, ["m"], "n", "i", 4).collect()
    assert sorted(sum(r["n"] for r in rows if r["m"] == 0 and r["chunk"] == c) for c in range(4)) == [13, 13, 13, 13]
    assert [sum(r["m"] == 1 and r["chunk"] == c for r in rows) for c in range(4)] == [2, 1, 1, 1]


def test_frame_indices(spark):
    n = F.lit(100)
    assert one(spark, sampling.frame_indices(4, n)) == [12, 37, 62, 87]
    assert one(spark, sampling.frame_indices(4, F.lit(3))) == [0, 1, 2, 2]
    assert one(spark, sampling.frame_indices(2, n, start=3)) == [3, 53]
    assert one(spark, sampling.frame_indices(0, F.lit(10), how="fps0.5", fps=1.0)) == [1, 3, 5, 7, 9]
    hashed = one(spark, sampling.frame_indices(5, n, how="rand", key=F.lit("k")))
    assert all(20 * i <= x < 20 * (i + 1) for i, x in enumerate(hashed))


def test_views_and_splits(spark):
    df = spark.createDataFrame([(s, v) for s in range(3) for v in range(40)], "s int, v int")
    rows = sampling.stratified_views(df, "s", "v", 4, 1).collect()
    assert sorted((r["s"], r["v"] // 10) for r in rows) == [(s, q) for s in range(3) for q in range(4)]
    near = sampling.near_views(df, "s", "v", 0.25, 4, 1).groupBy("s").agg(F.max("v") - F.min("v"), F.count("*")).collect()
    assert all(r[1] <= 10 and r[2] == 4 for r in near)
    parts = [one(spark, sampling.decayed_split(F.lit(20), F.lit(k), d)) for k in range(5) for d in (1.0, 0.5)]
    assert all(sum(p) == 20 and min(p) > 0 for p in parts)


# --- joins


def test_nearest_within_tolerance(spark):
    left = spark.createDataFrame([(i, "a", t) for i, t in enumerate((0.0, 0.25, 0.75, 5.0))] + [(9, "b", 0.0)], "id int, g string, t double")
    right = spark.createDataFrame([("a", 0.125, "x"), ("a", 0.375, "y"), ("a", 0.5, "z"), ("c", 0.0, "w")], "g string, t double, p string")
    got = {r["id"]: r["r_p"] for r in joins.nearest(left, right, ["g"], "t", 0.25, "id").collect()}
    assert got == {0: "x", 1: "x", 2: "z", 3: None, 9: None}


def test_backward_and_defaults(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 2, None), (1, 3, "b"), (1, 9, "c")], "k int, t int, v string")
    assert {(r["k"], r["t"]): r["last_v"] for r in joins.backward(left, right, ["k"], "t", "v").collect()} == {(1, 5): "b", (1, 1): None, (2, 5): None}
    work, done = spark.range(5).toDF("k"), spark.createDataFrame([(1,), (3,), (3,)], "k long")
    assert sorted(r["k"] for r in joins.not_yet_done(work, done, ["k"]).collect()) == [0, 2, 4]
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "x", 1), ("b", "y", 2), ("c", "z", None)], "k string, m string, v int")
    assert {r["k"]: r["missing"] for r in joins.missing_metrics(log, "k", "m", "v", ["x", "y"]).collect()} == {"a": ["y"], "c": ["x", "y"]}
    new = spark.createDataFrame([(1, "n"), (7, "n")], "k int, v string")
    old = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    assert sorted(tuple(r) for r in joins.upsert(old, new, ["k"]).collect()) == [(1, "n"), (2, "o"), (7, "n")]


# --- vectors


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_are_exact_in_blocks(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in similarity.neighbours(df, df, 3, metric, block=25).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    far = 1 - u @ u.T if metric == "cosine" else np.linalg.norm(u[:, None] - u[None], axis=2)
    np.fill_diagonal(far, np.inf)
    for q, ranked in got.items():
        assert [i for _, i in sorted(ranked)] == np.argsort(far[q])[:3].tolist()


def test_suppression_and_positions(spark):
    rows = [("i", "c", [0.0, 0.0, 9.0, 9.0], 0.9), ("i", "c", [0.0, 0.0, 9.0, 10.0], 0.8), ("i", "c", [50.0, 0.0, 60.0, 9.0], 0.7), ("i", "c", [80.0, 0.0, 90.0, 9.0], 0.1)]
    df = spark.createDataFrame(rows, "img string, cls string, box array<double>, score double")
    assert sorted(r["score"] for r in similarity.suppressed(df, limit=0.5).collect()) == [0.7, 0.9]
    assert similarity.suppressed(df, limit=0.5, most=1).count() == 1
    a, b = arr(0, 0, 10, 10), arr(100, 0, 110, 10)
    assert one(spark, G.relative_position(a, b)) == ["left of"] and one(spark, G.relative_position(b, a)) == ["right of"]
    assert one(spark, G.relative_position(arr(0, 100, 10, 110), a)) == ["below"] and one(spark, G.relative_position(a, a)) == []
    assert one(spark, G.iou(a, a)) == 1.0 and one(spark, G.iou(a, b)) == 0.0


def test_alignment_recovers_a_similarity(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(50, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    rot = q * np.sign(np.linalg.det(q))
    b = 2.5 * a @ rot.T + np.array([1.0, -2.0, 3.0])
    df = spark.createDataFrame([(1, x.tolist(), y.tolist()) for x, y in zip(a, b)], "g int, a array<double>, b array<double>")
    r = similarity.similarity_alignment(df, "g").first()
    assert abs(r["scale"] - 2.5) < 1e-9 and np.allclose(np.array(r["rotation"]).reshape(3, 3), rot) and np.allclose(r["translation"], [1, -2, 3])


# --- geometry


def test_poses(spark):
    turn = G.matrix_of_axis_angle(arr(0, 0, math.pi / 2))
    pose = G.pose_of(turn, arr(1, 2, 3))
    assert np.allclose(one(spark, G.transformed(pose, arr(1, 0, 0))), [1, 3, 3])
    assert np.allclose(one(spark, G.transformed(G.pose_inverse(pose), arr(1, 3, 3))), [1, 0, 0])
    assert abs(one(spark, G.rotation_angle(pose, G.identity())) - math.pi / 2) < 1e-9
    assert np.allclose(one(spark, G.matrix_of_quaternion(arr(1, 0, 0, 1))), one(spark, turn))
    assert np.allclose(one(spark, G.matrix_of_euler(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2))), one(spark, turn))
    assert one(spark, G.matrix_of_axis_angle(arr(0, 0, 0))) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    k = G.intrinsics(F.lit(500.0), F.lit(400.0), F.lit(320.0), F.lit(240.0))
    world = G.unprojected(F.lit(100.0), F.lit(50.0), F.lit(2000.0), k, pose)
    assert np.allclose(one(spark, G.projected(world, k, G.pose_inverse(pose))), [100, 50, 2])
    assert one(spark, G.is_visible(arr(1, 1, 2), F.lit(10), F.lit(10), F.lit(1.96))) is True
    assert one(spark, G.is_visible(arr(1, 1, 2), F.lit(10), F.lit(10), F.lit(1.9))) is False
    assert one(spark, G.voxel(arr(5, -1, 2.5), arr(0, 0, 0), arr(4, 4, 4), 1.0)) == [4, 0, 2]


def test_image_sizes(spark):
    size = lambda w, h: tuple(one(spark, V.resized(F.lit(w), F.lit(h), 1024, 512, 16, 1 << 20)))
    assert size(2048, 1024) == (1024, 512) and size(100, 100) == (512, 512) and size(640, 480) == (688, 512)
    assert tuple(one(spark, V.best_tiling(F.lit(896), F.lit(448)))) == (2, 1)
    assert one(spark, V.target_height(F.lit(0.7), 518, 14)) == 350
    assert one(spark, V.positions_extrapolated(F.lit(32), F.lit(48), 16, 70)) == [0, 1, 2, 70, 71, 72]
    assert one(spark, V.positions_interpolated(F.lit(32), F.lit(32), 16, 4)) == [0, 2, 8, 10]
    assert str(one(spark, V.rounded_half_up(F.lit(2.0005)))) == "2.001000000000" or float(one(spark, V.rounded_half_up(F.lit(2.0005)))) == 2.001


def test_attention(spark):
    modes, splits = ["causal", "noise", "full"], [2, 2, 2]
    rows = [(s * 2 + i, s, modes[s]) for s in range(3) for i in range(splits[s])]
    a = spark.createDataFrame([(p, s) for p, s, _ in rows], "q int, qs int")
    b = spark.createDataFrame(rows, "k int, ks int, mode string")
    got = {(r["q"], r["k"]) for r in a.crossJoin(b).filter(V.attends(F.col("q"), F.col("k"), F.col("qs"), F.col("ks"), F.col("mode"))).collect()}
    want = np.zeros((6, 6), bool)
    for s, m in enumerate(modes):
        lo, hi = 2 * s, 2 * s + 2
        want[lo:hi, lo:hi] = np.tril(np.ones((2, 2))) if m == "causal" else 1
        want[lo:hi, :lo] = 1
    want[:, 2:4] = False
    want[2:4, 2:4] = True
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(want))}


# --- metrics


def test_scores(spark):
    for c in range(11):
        answers = [1] * c + [0] * (10 - c)
        loop = np.mean([min(1, sum(answers[j] for j in range(10) if j != i) / 3) for i in range(10)])
        assert abs(one(spark, metrics.soft_vqa(F.lit(c))) - loop) < 1e-12
    texts = lambda *t: F.array(*[F.lit(x) for x in t])
    assert one(spark, metrics.anls(F.lit("hello"), texts("hallo", "x"))) == 0.8
    assert one(spark, metrics.anls(F.lit("abc"), texts("xyz"))) == 0.0 and one(spark, metrics.anls(F.lit(""), texts(""))) is None
    relaxed = lambda p, t: one(spark, metrics.relaxed_match(F.lit(p), F.lit(t)))
    assert relaxed("104", "100") and not relaxed("106", "100") and relaxed("50%", "0.5") and relaxed("Yes", "yes") and not relaxed("0.01", "0")
    assert one(spark, metrics.exact_match(F.lit(" A b"), texts("a B")))
    assert one(spark, metrics.viescore(arr(4, 9), arr(9))) == 6.0
    rise = lambda *a: one(spark, metrics.rise_score(*map(F.lit, a)))
    assert rise("logical_reasoning", 5, 1, None, False) == 1.1 and rise("causal_reasoning", 4, 4, 4, False) == 4.0 and rise("causal_reasoning", 1, 1, 1, True) == 1.0
    assert one(spark, metrics.rise_complete(F.lit("logical_reasoning"), F.lit(5), F.lit(5), F.lit(None).cast("int"))) == 1
    assert tuple(one(spark, metrics.rise_of_list(F.array(F.lit(1), F.lit(0))))) == (5, 1, None)


def test_error_auc_against_the_curve(spark):
    rng = np.random.default_rng(2)
    e = np.round(rng.exponential(5, 40), 1)
    df = spark.createDataFrame([(1, float(x)) for x in e], "g int, e double")
    errors = [0.0, *sorted(e)]
    recall = np.linspace(0, 1, len(errors))
    last = int(np.searchsorted(errors, 6.05))
    y, x = [*recall[:last], recall[last - 1]], [*errors[:last], 6.05]
    area = sum((x[i + 1] - x[i]) * (y[i + 1] + y[i]) / 2 for i in range(len(x) - 1)) / 6.05
    assert abs(metrics.error_auc(df, "g", "e", 6.05).first()["auc"] - area) < 1e-9


def test_logs_and_bleu(spark):
    log = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "x", 2.0, 2), ("a", "y", 3.0, 1), ("b", "x", 1.0, 1)], "k string, m string, v double, at int")
    assert [tuple(r) for r in metrics.complete_latest(log, "k", "m", "v", "at", ["x", "y"]).collect()] == [("a", 2.0, 3.0)]
    df = spark.createDataFrame([(1, "the cat sat on the mat", ["the cat sat on the mat"])], "k int, p string, r array<string>")
    assert abs(metrics.corpus_bleu(df, "k", "p", "r").first()["bleu"] - 1) < 1e-12
    df = spark.createDataFrame([(1, "the cat sat on mat today", ["the cat sat on the mat"]), (2, "a b", ["x y"])], "k int, p string, r array<string>")
    p = [(5 + 0) / 8, 3 / 6, 2 / 4, 1 / 3]
    assert abs(metrics.corpus_bleu(df, "k", "p", "r").first()["bleu"] - math.exp(sum(map(math.log, p)) / 4)) < 1e-9
    assert metrics.corpus_bleu(df.limit(0), "k", "p", "r").first()["bleu"] == 0


# --- conversations and windows


def test_template_and_placeholders(spark):
    seg = one(spark, conversations.template_segments(F.lit("a<vit_image>b<dino_image>"), F.lit("yes")))
    assert [(s["type"], s["loss"]) for s in seg] == [("text", False), ("text", False), ("vit", False), ("text", False), ("dino", False), ("text", False), ("text", True)]
    assert seg[-1]["value"] == "\nyes" and seg[0]["value"] == conversations.SYSTEM
    assert len(one(spark, conversations.template_segments(F.lit("q"), F.lit("")))) == 3
    geo = one(spark, conversations.template_segments(F.lit("q"), F.lit(""), "geo"))
    assert geo[1]["value"] == conversations.RECONSTRUCT + "q"
    grow = lambda t: one(spark, conversations.expanded_placeholder(F.lit(t), F.lit(2)))
    assert grow("a <image> b <image>") == "a <image><image> b <image>" and grow("x") == "<image><image>\nx" and grow("<video>x") == "<image><image>x"
    parts = one(spark, conversations.placeholder_elements(F.lit("a<image>b<image>"), 1))
    assert [(p["type"], p["value"]) for p in parts] == [("text", "a"), ("image", None), ("text", "b")]
    assert one(spark, conversations.lettered(F.array(F.lit("x"), F.lit("y")))) == "A. x\nB. y"
    assert one(spark, conversations.two_options(F.lit("(a) left (b) right"))) == ["left", "right"]
    w = one(spark, conversations.edit_window(arr(1, 2, 3, 4, 5), F.array(*[F.array(F.lit(f"s{i}")) for i in range(4)]), F.lit("k")))
    assert 0 <= w["start"] < w["end"] <= 4 and w["end"] - w["start"] <= 3 and w["instruction"].count("s") == w["end"] - w["start"]


def test_normalised_list(spark):
    df = spark.createDataFrame([([("user", None, "hi", None), (None, "gpt", None, ""), (None, "tool", None, "x")],)], "c array<struct<role:string,from:string,content:string,value:string>>")
    assert [tuple(t) for t in df.select(conversations.normalised_list(F.col("c")).alias("c")).first()["c"]] == [("human", "hi"), ("gpt", None), ("gpt", "x")]


def test_first_window_and_numbers(spark):
    df = spark.createDataFrame([(1, f) for f in (0, 50, 60, 70, 200, 210)] + [(2, 5)], "s int, f int")
    got = windows.first_window(df, "s", "f", 35, 3, "f").collect()
    assert [tuple(r) for r in got] == [(1, 50, 70, 3)]
    assert one(spark, windows.trailing_number(F.lit("a/b_12.jpg"))) == 12 and one(spark, windows.trailing_number(F.lit("a.jpg"))) == -1


# --- the registered queries


def test_registry_imports_and_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from loomwork.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name in ("chat_segments", "pack_bins_report", "weighted_rollup", "asof_nearest", "knn_cosine", "shard_ntile", "session_events"):
        got = catalog.queries()[name](spark, SF).toPandas()
        want = con.execute(catalog.oracle_sql()[name]).df()
        key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
        assert len(got) == len(want) and sorted(got.columns) == sorted(want.columns), name
        if name not in ("weighted_rollup", "asof_nearest"):  # nulls print differently
            assert key(got) == key(want), name


def test_masks_and_steps(spark):
    h, w = F.lit(8), F.lit(6)
    rect = one(spark, V.mask_cells(h, w, F.lit("k"), "rectangle", 0.25))
    on = [(i // 6, i % 6) for i, x in enumerate(rect) if x]
    assert len(rect) == 48 and len(on) == 12 and len({r for r, _ in on}) == 4 and len({c for _, c in on}) == 3
    assert 0 < sum(one(spark, V.mask_cells(h, w, F.lit("k"), "ellipse"))) < 48
    assert 5 < sum(one(spark, V.mask_cells(h, w, F.lit("k"), "random", 0.5))) < 43
    fine = F.array(*[F.lit(i == 7) for i in range(12)])  # 3 rows of 4: row 1, column 3
    assert one(spark, V.coarser_mask(fine, F.lit(3), F.lit(4), 2)) == [False, True, False, False]
    rows = spark.range(200).select(V.step_choices(1, F.col("id")).alias("s")).select("s.*").collect()
    assert {r["images"] for r in rows} == set(range(2, 9)) and all(0.5 <= r["aspect"] < 1.2 for r in rows)


def test_updates_and_relations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 1)], "k int, v string, at int")
    assert sorted(map(tuple, joins.updated(df, changes, "k", "v", "at").collect())) == [(1, "y"), (2, None), (3, None)]
    need = spark.createDataFrame([("i", "cat", "dog", "left of"), ("j", "cat", "dog", "left of"), ("k", "cat", "owl", "above")], "img string, cls string, target string, relation string")
    box = lambda x: [x, 0.0, x + 10, 10.0]
    seen = spark.createDataFrame([("i", "cat", box(0.0)), ("i", "dog", box(90.0)), ("j", "cat", box(0.0)), ("j", "cat", box(200.0)), ("j", "dog", box(90.0)), ("k", "cat", box(0.0))], "img string, cls string, box array<double>")
    assert {r["img"]: r["ok"] for r in joins.relations_hold(need, seen, G.relative_position).collect()} == {"i": True, "j": False, "k": False}


def test_prompt_suite(spark):
    import json

    from loomwork.operators import prompts

    nouns = ["cat", "apple", "bench", "bus"]
    rows = prompts.suite(spark, nouns, 30, 7).collect()
    by = {}
    for r in rows:
        by.setdefault(r["tag"], []).append(r)
    assert len(by["single_object"]) == 4 and set(by) == {"single_object", *prompts.TASKS}
    assert len({(r["tag"], r["include"]) for r in rows}) == len(rows)
    assert "a photo of an apple" in {r["prompt"] for r in by["single_object"]}
    assert all(2 <= json.loads(r["include"])[0]["count"] <= 4 for r in by["counting"])
    assert all(len({x["class"] for x in json.loads(r["include"])}) == 2 for r in by["position"])


def test_nearest_keeps_rows_of_equal_and_null_ids(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (None, "a", 1.0), (None, "a", 9.0)], "id long, g string, t double")
    right = spark.createDataFrame([("a", 1.1, "x"), ("a", 2.0, "y")], "g string, t double, p string")
    got = sorted((r["t"], r["id"] or 0, r["r_p"]) for r in joins.nearest(left, right, ["g"], "t", 0.25, "id").collect())
    assert got == [(1.0, 0, "x"), (1.0, 1, "x"), (2.0, 1, "y"), (9.0, 0, None)]
    assert [r["r_p"] for r in joins.nearest(left, right, ["g"], "t", 0.0, "id").orderBy("t", "id").collect()] == [None, None, "y", None]


def test_join_counts(spark):
    from loomwork.operators import lookups

    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, v string")
    rows, counts = lookups.matched(left, right, ["k"])
    assert rows.count() == 2 and tuple(counts.first()) == (4, 3, 2, 2)
    assert tuple(lookups.matched(left.limit(0), right.limit(0), ["k"])[1].first()) == (0, 0, 0, 0)
