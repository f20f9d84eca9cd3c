"""Registered queries of poses, scenes, sequence plans, masks and prompt suites, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import geometry, vision
from loomwork.operators import binning, poses, prompts, scenes, sequences
from loomwork.plans import catalog
from loomwork.plans.catalog import query
from loomwork.plans.tables import Tables


def _c(name: str) -> Column:
    return F.col(name)


# --- poses: a label's vectors are the frames of a scene

#: Unit quaternions and translations of all frames, these scaled by the scene's mean length.
_FRAMES = """WITH f AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT label, vec_id, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS l, e, sqrt(e[5] * e[5] + e[6] * e[6] + e[7] * e[7]) AS far FROM f),
q AS (SELECT label, vec_id, e[1] / l AS w, e[2] / l AS x, e[3] / l AS y, e[4] / l AS z, e[5] / m AS tx, e[6] / m AS ty, e[7] / m AS tz FROM (SELECT *, avg(far) OVER (PARTITION BY label) AS m FROM n)),
d AS (SELECT a.label, a.vec_id AS ref, b.vec_id AS id, round(2 * acos(least(1.0, abs(a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z))) / pi()
 + sqrt((a.tx - b.tx) ** 2 + (a.ty - b.ty) ** 2 + (a.tz - b.tz) ** 2), 9) AS distance FROM q a JOIN q b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


def _poses(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("label", "vec_id", geometry.pose_of(geometry.matrix_of_quaternion(F.slice(v, 1, 4)), F.slice(v, 5, 3)).alias("pose"), v.alias("e"))


@query(_FRAMES + """, r AS (SELECT *, row_number() OVER (PARTITION BY label, ref ORDER BY distance, id) AS rank FROM d)
SELECT label, ref, id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def nearest_poses(t: Tables) -> DataFrame:
    """The five nearest frames of every frame, in blocks of 16, so that a scene is several of them."""
    found = poses.nearest_poses(_poses(t), "label", "vec_id", "pose", 5, block=16)
    return found.select("label", "ref", "id", F.round("distance", 6).alias("distance"), "rank")


@query(_FRAMES + """, p AS (SELECT label, arg_min(vec_id, md5(label || ':' || vec_id || ':9')) AS ref FROM f GROUP BY label),
r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS rank FROM (SELECT d.label, id, distance FROM d JOIN p ON d.label = p.label AND d.ref = p.ref UNION ALL SELECT label, ref, -1 FROM p)),
l AS (SELECT label, list(id ORDER BY rank) AS near FROM r WHERE rank <= 24 GROUP BY label)
SELECT label, place::INTEGER AS place, near[CASE WHEN place = 0 THEN 1 ELSE 1 + ('0x' || left(md5(label || ':' || place || ':9'), 8))::BIGINT % len(near) END] AS vec_id FROM l, range(0, 12) t(place)""")
def near_pose_sample(t: Tables) -> DataFrame:
    return poses.near_pose_sample(_poses(t), "label", "vec_id", "pose", 12, 1.0, 9).select("label", "place", "vec_id")


# --- scenes: a label is a scene, its vectors are frames with four depth pixels each; one frame has no pose, one no depth image

_FOLDER = "/data/posed"
_SCENES = """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, 'scene' || lpad(label::VARCHAR, 4, '0') || '_00' AS scene FROM embeddings),
q AS (SELECT label, vec_id, scene, e, e[1] / l AS w, e[2] / l AS x, e[3] / l AS y, e[4] / l AS z FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS l FROM e)),
p AS (SELECT q.*, u, floor(greatest(e[9 + u], 0) * 1000) AS mm FROM q, range(0, 4) t(u) WHERE vec_id <> 23),
c AS (SELECT *, (100 * u - 320) * mm / 1000 / (500 + label) AS cx, (50 * u - 240) * mm / 1000 / (500 + label) AS cy, mm / 1000 AS cz FROM p),
m AS (SELECT *, (1 - 2 * (y * y + z * z)) * cx + 2 * (x * y - w * z) * cy + 2 * (x * z + w * y) * cz + e[5] AS mx,
 2 * (x * y + w * z) * cx + (1 - 2 * (x * x + z * z)) * cy + 2 * (y * z - w * x) * cz + e[6] AS my,
 2 * (x * z - w * y) * cx + 2 * (y * z + w * x) * cy + (1 - 2 * (x * x + y * y)) * cz + e[7] AS mz FROM c),
s AS (SELECT scene, label, count(*) AS frames, bool_or(vec_id = 17) AS unposed, bool_or(vec_id = 23) AS flat, min(vec_id) AS first_id FROM e GROUP BY ALL),
b AS (SELECT scene, [coalesce(min(-my + label) FILTER (mm > 0), 0), coalesce(max(-my + label) FILTER (mm > 0), 0), coalesce(min(mx) FILTER (mm > 0), 0), coalesce(max(mx) FILTER (mm > 0), 0),
 coalesce(min(mz + 1) FILTER (mm > 0), 0), coalesce(max(mz + 1) FILTER (mm > 0), 0)] AS boundary FROM m GROUP BY scene),
g AS (SELECT s.*, boundary FROM s JOIN b ON s.scene = b.scene WHERE NOT unposed AND NOT flat),
i AS (SELECT conv_id, conv_id % 12 AS label, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS question, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id)"""


class _Scenes:
    """The tables that the scene operators read."""

    def __init__(self, t: Tables):
        scene = F.concat(F.lit("scene"), F.lpad(_c("label").cast("string"), 4, "0"), F.lit("_00"))
        number_text = _c("vec_id").cast("string")  # padded, but never cut
        frames = _poses(t).withColumn("scene", scene).withColumn("name", F.lpad(number_text, F.greatest(F.lit(5), F.length(number_text)), F.lit("0")))
        number = lambda *x: F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in x])
        label = _c("label").cast("double")
        image = F.concat(F.lit("scannet/"), "scene", F.lit("/"), "name", F.lit(".jpg"))
        by = frames.groupBy("scene", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", image.alias("image")))), lambda x: x["image"]).alias("images"))
        self.scenes = by.select(
            F.concat(F.lit("scannet/"), "scene").alias("video_id"), "images",
            number(0, -1, 0, label, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1).alias("axis_align"),
            number(label + 500, 0, 320, 0, 0, label + 500, 240, 0, 0, 0, 1, 0, 0, 0, 0, 1).alias("depth_cam2img"),
        )
        path = lambda suffix: F.concat(F.lit(f"{_FOLDER}/"), "scene", F.lit("/"), "name", F.lit(suffix))
        self.poses = frames.filter("vec_id <> 17").select(path(".txt").alias("path"), "pose")
        deep = frames.filter("vec_id <> 23").select(path(".png").alias("path"), F.posexplode(F.slice("e", 9, 4)).alias("k", "depth"))
        self.depths = deep.select("path", (_c("k") * 100).alias("u"), (_c("k") * 50).alias("v"), F.floor(F.greatest(_c("depth"), F.lit(0.0)) * 1000).alias("depth_mm"))
        named = F.when(_c("label") == 4, F.concat(F.lit("scannet/"), "scene")).otherwise(_c("scene"))
        self.objects = by.filter("label % 2 = 0").select(named.alias("scene_id"), F.concat(F.lit('["box '), "label", F.lit('"]')).alias("objects"))
        turn = F.struct("turn", F.when(_c("role") == "user", "human").when(_c("role") == "assistant", "gpt").otherwise(_c("role")).alias("from"), _c("text").alias("value"))
        asked = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))
        at = _c("conv_id") % 12
        self.items = asked.select(
            _c("conv_id").cast("string").alias("id"), F.concat(F.lit("scannet/scene"), F.lpad(at.cast("string"), 4, "0"), F.lit("_00")).alias("video"), "conversations",
            F.when(_c("conv_id") % 3 == 0, F.array(F.lit("yes"), F.lit("sure"))).alias("answers"),
            F.when(_c("conv_id") % 2 == 0, "scanrefer").otherwise(F.lit("scan2cap")).alias("dataset"),
            F.array(F.lit(1.0), F.lit(2.0)).alias("box_input"), F.array(F.array(_c("conv_id").cast("double"))).alias("box"),
        )

    def rows(self) -> tuple[DataFrame, DataFrame]:
        return scenes.scene_rows(self.scenes, self.poses, self.depths, _FOLDER)


@query(_SCENES + """ SELECT 'scannet/' || scene AS video_id, frames::INTEGER AS frames, list_transform(boundary, lambda v: round(v, 6)) AS boundary,
 '/data/posed/' || scene || '/' || lpad(first_id::VARCHAR, 5, '0') || '.png' AS first_depth, 500.0 + label AS fx FROM g""")
def scene_bounds(t: Tables) -> DataFrame:
    rows, _ = _Scenes(t).rows()
    return rows.select("video_id", F.size("poses").alias("frames"), F.transform("boundary", lambda v: F.round(v, 6) + 0.0).alias("boundary"), F.get("depth_list", F.lit(0)).alias("first_depth"), F.get("depth_intrinsic", F.lit(0)).alias("fx"))


@query(_SCENES + """ SELECT conv_id::VARCHAR AS qa_id, question, answer, frames::INTEGER AS images, '/data/posed/' || scene || '/' || lpad(first_id::VARCHAR, 5, '0') || '.jpg' AS first_image,
 CASE WHEN conv_id % 3 = 0 THEN ['yes', 'sure'] WHEN answer = '' THEN [] ELSE [answer] END AS answers, 'scanqa' AS dataset_name FROM i JOIN g ON i.label = g.label""")
def scanqa_rows(t: Tables) -> DataFrame:
    s = _Scenes(t)
    good, _ = scenes.scanqa_samples(s.items, s.rows()[0])
    meta = F.from_json("metadata", "qa_id string, answers array<string>")
    return good.select(meta["qa_id"].alias("qa_id"), "question", "answer", F.size("image_path").alias("images"), F.get("image_path", F.lit(0)).alias("first_image"), meta["answers"].alias("answers"), "dataset_name")


@query(_SCENES + """ SELECT conv_id::VARCHAR AS id, question, answer, 'video3dllm_' || CASE WHEN conv_id % 2 = 0 THEN 'scanrefer' ELSE 'scan2cap' END AS dataset_name, list_transform(boundary, lambda v: round(v, 6)) AS boundary,
 CASE WHEN g.label % 2 = 0 THEN '["box ' || g.label || '"]' ELSE '[]' END AS objects, CASE WHEN conv_id % 2 = 0 THEN [[conv_id::DOUBLE]] END AS box, CASE WHEN conv_id % 2 = 1 THEN [1.0, 2.0]::DOUBLE[] END AS box_input,
 4 * frames::INTEGER AS points FROM i JOIN g ON i.label = g.label""")
def video3d_rows(t: Tables) -> DataFrame:
    """With the scenes' points, whose list is written and read once a scene: a scene has many items, and a copy for each would be their product."""
    s = _Scenes(t)
    pointed = scenes.points(scenes.frames(s.scenes, s.poses, _FOLDER), s.depths)
    listed = scenes.world_coords(pointed).select("video_id", F.size(F.from_json("world_coords", "array<array<double>>")).alias("points"))
    good, _ = scenes.video3d_samples(s.items, s.rows()[0], s.objects)
    meta = F.from_json("metadata", "id string, video_id string, box_input array<double>, box array<array<double>>")
    return good.withColumn("video_id", meta["video_id"]).join(listed, "video_id", "left").select(
        meta["id"].alias("id"), "question", "answer", "dataset_name", F.transform("boundary", lambda v: F.round(v, 6) + 0.0).alias("boundary"), "objects", meta["box"].alias("box"), meta["box_input"].alias("box_input"),
        "points",
    )


@query(_SCENES + """ SELECT 'scannet/' || scene AS what, CASE WHEN unposed THEN 'no pose' ELSE 'no depth' END AS reason FROM s WHERE unposed OR flat
UNION ALL SELECT conv_id::VARCHAR, 'no scene' FROM i WHERE label NOT IN (SELECT label FROM g)""")
def scene_rejects(t: Tables) -> DataFrame:
    s = _Scenes(t)
    rows, bad = s.rows()
    _, asked = scenes.scanqa_samples(s.items, rows)
    return bad.select(_c("video_id").alias("what"), "reason").unionByName(asked.select(_c("id").alias("what"), "reason"))


# --- sequence plans: turns are texts, user turns bring an image, every fifth conversation begins with a clip

_SEGMENTS = """WITH t AS (SELECT conv_id, turn, role, length(text) // 4 AS n FROM conversations),
x AS (SELECT conv_id AS sample, 10 * turn + 5 AS k, 'text' AS kind, n AS length, 0 AS gh, 0 AS gw, role = 'assistant' AS loss, role = 'system' AND conv_id % 3 = 0 AS dropped, NULL::INTEGER AS clip, NULL::INTEGER AS frame FROM t
 UNION ALL SELECT conv_id, 10 * turn, 'vit_image', 0, 2 * (1 + n % 5), 2 * (1 + n % 7), false, (conv_id + turn) % 4 = 0, NULL, NULL FROM t WHERE role = 'user'
 UNION ALL SELECT conv_id, -10 + f, 'vae_image', 0, 4, 6, false, false, 1, (f * f)::INTEGER FROM (SELECT DISTINCT conv_id FROM t), range(0, 4) r(f) WHERE conv_id % 5 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY k) AS seg, CASE WHEN dropped THEN 0 WHEN kind = 'text' THEN length + loss::INTEGER ELSE (gh // 2) * (gw // 2) + 2 END AS tokens FROM x),
a AS (SELECT *, CASE WHEN kind = 'text' THEN tokens WHEN dropped THEN 1 ELSE greatest(1, gh // 2, gw // 2) + 2 END AS advance FROM o),
w AS (SELECT *, coalesce(sum(tokens) OVER b, 0)::BIGINT AS start, coalesce(sum(advance) OVER b, 0)::BIGINT AS position, coalesce(clip = lag(clip) OVER s, false) AS goes_on, coalesce(clip = lead(clip) OVER s, false) AS more, lead(frame) OVER s AS next_frame
 FROM a WINDOW s AS (PARTITION BY sample ORDER BY seg), b AS (PARTITION BY sample ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (sum((NOT goes_on)::INTEGER) OVER (PARTITION BY sample ORDER BY seg) - 1)::INTEGER AS split FROM w)"""


def _segments(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", F.floor(F.char_length("text") / 4).alias("n"))
    grid = lambda h, w: F.struct(F.lit(1).alias("t"), h.cast("int").alias("h"), w.cast("int").alias("w"))
    none = F.lit(None).cast("int")
    shape = ["sample", "k", "kind", "length", "grid", "loss", "dropped", "clip", "frame"]
    texts = turns.select(_c("conv_id"), _c("turn") * 10 + 5, F.lit("text"), "n", grid(F.lit(0), F.lit(0)), _c("role") == "assistant", (_c("role") == "system") & (_c("conv_id") % 3 == 0), none, none).toDF(*shape)
    images = turns.filter("role = 'user'").select(_c("conv_id"), _c("turn") * 10, F.lit("vit_image"), F.lit(0).cast("bigint"), grid(2 * (1 + _c("n") % 5), 2 * (1 + _c("n") % 7)), F.lit(False), (_c("conv_id") + _c("turn")) % 4 == 0, none, none).toDF(*shape)
    clips = turns.select("conv_id").distinct().filter("conv_id % 5 = 0").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(3))))
    clips = clips.select(_c("conv_id"), (_c("f") - 10).cast("bigint"), F.lit("vae_image"), F.lit(0).cast("bigint"), grid(F.lit(4), F.lit(6)), F.lit(False), F.lit(False), F.lit(1), _c("f") * _c("f")).toDF(*shape)
    every = texts.unionByName(images).unionByName(clips)
    return every.withColumn("seg", F.expr("row_number() OVER (PARTITION BY sample ORDER BY k)"))


@query(_SEGMENTS + """ SELECT sample, seg::INTEGER AS seg, kind, tokens::BIGINT AS tokens, advance::BIGINT AS advance, start, position, NOT goes_on AS split_start, NOT more AS split_end,
 CASE WHEN more THEN next_frame - frame END AS frame_delta, split, (sum(tokens) OVER (PARTITION BY sample, split))::BIGINT AS split_tokens, CASE kind WHEN 'text' THEN 'causal' ELSE 'full' END AS mode FROM p""")
def sequence_plan(t: Tables) -> DataFrame:
    found = sequences.plan(_segments(t))
    return found.select("sample", "seg", "kind", "tokens", "advance", "start", "position", "split_start", "split_end", "frame_delta", "split", "split_tokens", "mode")


_PLAN_BUDGET = binning.Budget(most=4096, expected=3584, per_sample=3000, carry=True)


@query(_SEGMENTS.replace("WITH t AS", "WITH RECURSIVE t AS") + """, z AS (SELECT sample, sum(tokens)::BIGINT AS n FROM p GROUP BY sample), y AS (SELECT sample, n, row_number() OVER (ORDER BY sample) AS i FROM z WHERE n <= 3000),
g AS (SELECT 0::BIGINT AS i, 0::BIGINT AS curr, 0::BIGINT AS bin, NULL::BIGINT AS sample, NULL::BIGINT AS start_at, NULL::BIGINT AS in_bin
 UNION ALL SELECT i, CASE WHEN full_now >= 3584 THEN 0 ELSE full_now END, CASE WHEN full_now >= 3584 THEN in_bin + 1 ELSE in_bin END, sample, full_now - n, in_bin FROM (
  SELECT y.i, y.sample, y.n, CASE WHEN g.curr + y.n > 4096 THEN y.n ELSE g.curr + y.n END AS full_now, CASE WHEN g.curr + y.n > 4096 AND g.curr > 0 THEN g.bin + 1 ELSE g.bin END AS in_bin FROM g JOIN y ON y.i = g.i + 1))
SELECT p.sample, seg::INTEGER AS seg, in_bin AS bin, start + start_at AS start, position FROM p JOIN g ON p.sample = g.sample""")
def sequence_plan_in_bins(t: Tables) -> DataFrame:
    """The plan's samples packed in order of their ids, and every segment's place in its bin."""
    found = sequences.plan(_segments(t))
    samples = sequences.lengths(found).select(F.lit(0).alias("shard"), _c("sample").alias("rn"), _c("sample").alias("id"), "tokens")
    return sequences.in_bins(found, binning.packed(samples, _PLAN_BUDGET)).select("sample", "seg", "bin", "start", "position")


# --- masks

_GRID = """WITH RECURSIVE m AS (SELECT p_partkey AS id, 3 + p_size % 4 AS h, 4 + p_partkey % 3 AS w, 0.2 + (p_partkey % 3) * 0.2 AS share FROM part WHERE p_size <= 12),
n AS (SELECT *, greatest(1, round_even(h * w * 0.4, 0))::INTEGER AS target FROM m)"""


@query(_GRID + """, g AS (SELECT id, list_value(('0x' || left(md5(id || ':start'), 6))::BIGINT % (h * w)) AS reached, 0 AS t FROM n
UNION ALL SELECT id, list_concat(reached, list_filter(list_transform(list_sort(list_transform([[1, 0], [-1, 0], [0, 1], [0, -1]], lambda d, k: {'o': ('0x' || left(md5(id || ':' || t || ':' || (k - 1)), 6))::BIGINT, 'k': k,
 'c': CASE WHEN y + d[1] >= 0 AND y + d[1] < h AND x + d[2] >= 0 AND x + d[2] < w THEN cell + d[1] * w + d[2] END})), lambda s: s.c), lambda c: c IS NOT NULL AND NOT list_contains(reached, c))), t + 1
 FROM (SELECT g.id, reached, t, h, w, target, reached[t + 1] AS cell, reached[t + 1] // w AS y, reached[t + 1] % w AS x FROM g JOIN n ON g.id = n.id WHERE t < target))
SELECT g.id, list_transform(range(0, h * w), lambda k: list_contains(reached[:target], k)) AS cells FROM g JOIN n ON g.id = n.id WHERE t = target""")
def walk_masks(t: Tables) -> DataFrame:
    p = t.part.filter("p_size <= 12").select(_c("p_partkey").alias("id"), (3 + _c("p_size") % 4).alias("h"), (4 + _c("p_partkey") % 3).alias("w"))
    return p.select("id", vision.walk_cells(_c("h"), _c("w"), _c("id"), 0.4).alias("cells"))


@query(_GRID.replace("RECURSIVE ", "") + """, k AS (SELECT *, CASE WHEN s % 2 = 0 THEN s + 1 ELSE s END // 2 AS r FROM (SELECT *, least(10, h, w) AS s FROM n)),
c AS (SELECT id, h, w, r, target, k // w AS y, k % w AS x, k AS cell FROM k, unnest(range(0, h * w)) t(k)),
v AS (SELECT id, y, x, ('0x' || left(md5(id || ':' || y || ':' || x), 6))::BIGINT AS raw FROM c),
j AS (SELECT c.id, c.cell, c.target, sum(v.raw) AS s FROM (SELECT c.*, ((y + dy) % (2 * h) + 2 * h) % (2 * h) AS yy, ((x + dx) % (2 * w) + 2 * w) % (2 * w) AS xx FROM c, unnest(range(-r, r + 1)) a(dy), unnest(range(-r, r + 1)) b(dx)) c
 JOIN v ON v.id = c.id AND v.y = CASE WHEN yy < h THEN yy ELSE 2 * h - 1 - yy END AND v.x = CASE WHEN xx < w THEN xx ELSE 2 * w - 1 - xx END GROUP BY ALL),
q AS (SELECT *, list_reverse_sort(list(s) OVER (PARTITION BY id))[target] AS lowest FROM j)
SELECT id, list(s >= lowest ORDER BY cell) AS cells FROM q GROUP BY id""")
def blob_masks(t: Tables) -> DataFrame:
    p = t.part.filter("p_size <= 12").select(_c("p_partkey").alias("id"), (3 + _c("p_size") % 4).alias("h"), (4 + _c("p_partkey") % 3).alias("w"))
    return p.select("id", vision.blob_cells(_c("h"), _c("w"), _c("id"), 0.4).alias("cells"))


# --- prompt suites

_NOUNS = ("person", "bench", "apple", "bus", "umbrella", "toothbrush")


@query("""WITH n AS (SELECT ['person', 'bench', 'apple', 'bus', 'umbrella', 'toothbrush'] AS nouns, ['bench', 'apple', 'bus', 'umbrella', 'toothbrush'] AS things,
 ['red', 'orange', 'yellow', 'green', 'blue', 'purple', 'pink', 'brown', 'black', 'white'] AS tones, ['two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'] AS counts, ['left of', 'right of', 'above', 'below'] AS rels),
k AS (SELECT p_partkey AS i, tag, lambda_key FROM part, unnest(['two_object', 'counting', 'colors', 'position', 'color_attr']) t(tag), LATERAL (SELECT '3:' || tag || ':' || p_partkey || ':' AS lambda_key)),
h AS (SELECT i, tag, ('0x' || left(md5(lambda_key || 'a'), 8))::BIGINT AS ha, ('0x' || left(md5(lambda_key || 'b'), 8))::BIGINT AS hb, ('0x' || left(md5(lambda_key || 'c1'), 8))::BIGINT AS h1, ('0x' || left(md5(lambda_key || 'c2'), 8))::BIGINT AS h2,
 ('0x' || left(md5(lambda_key || 'n'), 8))::BIGINT AS hn, ('0x' || left(md5(lambda_key || 'rel'), 8))::BIGINT AS hr FROM k),
d AS (SELECT i, tag, CASE WHEN tag IN ('colors', 'color_attr') THEN things[1 + ha % 5] ELSE nouns[1 + ha % 6] END AS a, CASE WHEN tag IN ('colors', 'color_attr') THEN things[1 + (ha % 5 + 1 + hb % 4) % 5] ELSE nouns[1 + (ha % 6 + 1 + hb % 5) % 6] END AS b,
 tones[1 + h1 % 10] AS c1, tones[1 + (h1 % 10 + 1 + h2 % 9) % 10] AS c2, 2 + hn % 9 AS n, rels[1 + hr % 4] AS rel, counts FROM h, n),
w AS (SELECT *, CASE WHEN a[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || a AS one_a, CASE WHEN b[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || b AS one_b,
 CASE WHEN c1[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || c1 AS one_c1, CASE WHEN c2[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || c2 AS one_c2,
 a || CASE WHEN right(a, 2) IN ('ch', 'sh') OR right(a, 1) IN ('s', 'x') THEN 'es' ELSE 's' END AS many FROM d),
s AS (SELECT i, tag, 'a photo of ' || CASE tag WHEN 'two_object' THEN one_a || ' and ' || one_b WHEN 'counting' THEN counts[n - 1] || ' ' || many WHEN 'colors' THEN one_c1 || ' ' || a WHEN 'position' THEN one_a || ' ' || rel || ' ' || one_b ELSE one_c1 || ' ' || a || ' and ' || one_c2 || ' ' || b END AS prompt,
 CASE tag WHEN 'two_object' THEN '[{"class":"' || a || '","count":1},{"class":"' || b || '","count":1}]' WHEN 'counting' THEN '[{"class":"' || a || '","count":' || n || '}]' WHEN 'colors' THEN '[{"class":"' || a || '","count":1,"color":"' || c1 || '"}]'
 WHEN 'position' THEN '[{"class":"' || b || '","count":1},{"class":"' || a || '","count":1,"position":"' || rel || '","target":0}]' ELSE '[{"class":"' || a || '","count":1,"color":"' || c1 || '"},{"class":"' || b || '","count":1,"color":"' || c2 || '"}]' END AS include,
 CASE WHEN tag = 'counting' THEN '[{"class":"' || a || '","count":' || (n + 1) || '}]' END AS exclude FROM w)
SELECT tag, prompt, include, exclude FROM (SELECT *, row_number() OVER (PARTITION BY tag, include ORDER BY i) AS r FROM s) WHERE r = 1""")
def prompt_suite(t: Tables) -> DataFrame:
    """A draw of each task for every part, counts to ten, without repeats."""
    found = prompts.drawn(t.spread("part", "p_partkey").select(_c("p_partkey").alias("i")), list(_NOUNS), 3, most=10)
    return prompts.deduplicated(found)
