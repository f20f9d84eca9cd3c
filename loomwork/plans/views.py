"""Registered queries of image arithmetic, frame choices and placeholders, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import vision
from loomwork.operators import conversations, lookups, metrics, sampling, windows
from loomwork.plans.catalog import query
from loomwork.plans.tables import Tables
from loomwork.sources import sinks


def _c(name: str) -> Column:
    return F.col(name)


# --- image sizes and positions


def _edge(x: str, scale: str) -> str:
    return f"greatest(16, (round_even(round_even({x} * {scale}, 0) / 16, 0) * 16)::INT)"


@query(f"""WITH p AS (SELECT p_partkey, (p_size * 41)::INT AS w, (7 + p_size * p_size)::INT AS h FROM part),
a AS (SELECT *, greatest(least(1024.0::DOUBLE / greatest(w, h), 1), 256.0::DOUBLE / least(w, h)) AS s FROM p),
b AS (SELECT p_partkey, {_edge("w", "s")} AS w, {_edge("h", "s")} AS h FROM a),
c AS (SELECT *, sqrt(700000.0::DOUBLE / (w * h)) AS s FROM b),
d AS (SELECT p_partkey, CASE WHEN w * h > 700000 THEN {_edge("w", "s")} ELSE w END AS w, CASE WHEN w * h > 700000 THEN {_edge("h", "s")} ELSE h END AS h FROM c),
e AS (SELECT *, 1024.0::DOUBLE / greatest(w, h) AS s FROM d)
SELECT p_partkey, CASE WHEN greatest(w, h) > 1024 THEN {_edge("w", "s")} ELSE w END AS width, CASE WHEN greatest(w, h) > 1024 THEN {_edge("h", "s")} ELSE h END AS height FROM e""")
def resized_images(t: Tables) -> DataFrame:
    size = vision.resized(_c("p_size") * 41, 7 + _c("p_size") * _c("p_size"), 1024, 256, 16, 700_000)
    return t.part.select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("""WITH g AS (SELECT i, j FROM (SELECT unnest(range(1, 13)) AS i), (SELECT unnest(range(1, 13)) AS j) WHERE i * j <= 12),
p AS (SELECT p_partkey, (100 + p_partkey % 37 * 50)::DOUBLE AS w, (100 + p_size * 30)::DOUBLE AS h FROM part),
o AS (SELECT p_partkey, w * h AS area, i, j, abs(w / h - i / j) AS off FROM p, g), m AS (SELECT *, min(off) OVER (PARTITION BY p_partkey) AS least FROM o),
r AS (SELECT p_partkey, i, j, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN area > 0.5 * 448 * 448 * i * j THEN -(i * j) ELSE i * j END) AS r FROM m WHERE off = least)
SELECT p_partkey, i::INT AS columns, j::INT AS rows FROM r WHERE r = 1""")
def best_tilings(t: Tables) -> DataFrame:
    w, h = (100 + _c("p_partkey") % 37 * 50).cast("double"), (100 + _c("p_size") * 30).cast("double")
    return t.part.select("p_partkey", vision.best_tiling(w, h).alias("g")).select("p_partkey", "g.columns", "g.rows")


@query("""SELECT p_partkey, (floor(floor(518 * (0.5 + p_size / 64.0::DOUBLE)) / 14) * 14)::INT AS height, round(p_size::DECIMAL(38, 12) / 16, 3)::DOUBLE AS rounded FROM part""")
def target_heights(t: Tables) -> DataFrame:
    aspect = 0.5 + _c("p_size") / 64.0
    return t.part.select("p_partkey", vision.target_height(aspect, 518, 14).alias("height"), vision.rounded_half_up(_c("p_size") / 16).cast("double").alias("rounded"))


@query("""WITH d AS (SELECT p_partkey, 1 + p_size % 5 AS h, 1 + p_size % 7 AS w FROM part)
SELECT p_partkey, list_transform(range(0, h * w), lambda i: (least(i // w * 70 // h, 69) * 70 + least(i % w * 70 // w, 69))::BIGINT) AS ids FROM d""")
def patch_positions_spread(t: Tables) -> DataFrame:
    ids = vision.positions_interpolated(16 * (1 + _c("p_size") % 5), 16 * (1 + _c("p_size") % 7), 16, 70)
    return t.part.select("p_partkey", F.transform(ids, lambda i: i.cast("bigint")).alias("ids"))


@query("""WITH t AS (SELECT conv_id, turn, turn // 2 AS split, CASE WHEN turn // 2 % 3 = 0 THEN 'noise' WHEN turn // 2 % 3 = 1 THEN 'causal' ELSE 'full' END AS mode FROM conversations)
SELECT q.conv_id, q.turn, count(*) FILTER (CASE WHEN k.split <> q.split THEN k.mode <> 'noise' AND k.split < q.split WHEN k.mode = 'causal' THEN k.turn <= q.turn ELSE true END) AS seen
FROM t q JOIN t k ON q.conv_id = k.conv_id GROUP BY q.conv_id, q.turn""")
def attention_counts(t: Tables) -> DataFrame:
    split = F.floor(_c("turn") / 2)
    mode = F.when(split % 3 == 0, "noise").when(split % 3 == 1, "causal").otherwise("full")
    rows = t.conversations.select("conv_id", "turn", split.alias("split"), mode.alias("mode"))
    keys = rows.select("conv_id", _c("turn").alias("k_turn"), _c("split").alias("k_split"), _c("mode").alias("k_mode"))
    sees = vision.attends(_c("turn"), _c("k_turn"), _c("split"), _c("k_split"), _c("k_mode"))
    return rows.join(keys, "conv_id").groupBy("conv_id", "turn").agg(F.count_if(sees).alias("seen"))


@query("""WITH c AS (SELECT p_partkey, list_transform(range(0, 20), lambda k: (p_partkey + k * k) % 7 = 0) AS cells FROM part)
SELECT p_partkey, list_transform(range(0, 6), lambda b: len(list_filter(range(0, 20), lambda k: cells[k + 1] AND k // 5 // 2 = b // 3 AND k % 5 // 2 = b % 3)) > 0) AS coarse FROM c""")
def coarser_masks(t: Tables) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: (_c("p_partkey") + k * k) % 7 == 0)
    return t.part.select("p_partkey", vision.coarser_mask(cells, F.lit(4), F.lit(5), 2).alias("coarse"))


# --- frames


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM p WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda k: k * n // 8), i)""")
def linspace_starts(t: Tables) -> DataFrame:
    return sampling.linspace_rows(t.events, ["user_id"], ["event_id"], 8, "starts").select("user_id", "event_id")


@query("""WITH p AS (SELECT p_partkey, p_size, least(8, p_size) AS n FROM part),
m AS (SELECT p_partkey, p_size, n, list_transform(range(0, n), lambda i: ((i * p_size // n + (i + 1) * p_size // n - 1) // 2)::INT) AS middle, list_transform(range(0, n), lambda i: (i * p_size // n + 1)::INT) AS fixed FROM p)
SELECT p_partkey, list_concat(middle, list_transform(range(0, 8 - n), lambda i: middle[n])) AS middle, list_concat(fixed, list_transform(range(0, 8 - n), lambda i: fixed[n])) AS fixed,
 list_filter(list_transform(range(0, greatest(1, ceil(p_size / 4.0::DOUBLE / 0.5)::BIGINT)), lambda i: round_even((i * 0.5::DOUBLE + 0.25::DOUBLE) * 4, 0)::INT), lambda x: x < p_size) AS at_fps FROM m""")
def frame_choices(t: Tables) -> DataFrame:
    n = _c("p_size")
    return t.part.select("p_partkey", sampling.frame_indices(8, n).alias("middle"), sampling.frame_indices(8, n, start=1).alias("fixed"), sampling.frame_indices(8, n, "fps2", fps=4.0).alias("at_fps"))


@query("""WITH v AS (SELECT label AS scene, vec_id, floor((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 4 / count(*) OVER (PARTITION BY label)) AS s FROM embeddings)
SELECT scene, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY scene, s ORDER BY md5(concat_ws(':', scene::VARCHAR, vec_id::VARCHAR, '6')), vec_id) AS r FROM v) WHERE r = 1""")
def stratified_views(t: Tables) -> DataFrame:
    return sampling.stratified_views(t.embeddings.withColumnRenamed("label", "scene"), "scene", "vec_id", 4, 6).select("scene", "vec_id")


@query("""WITH o AS (SELECT label AS scene, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n, first_value(vec_id) OVER (PARTITION BY label ORDER BY md5(concat_ws(':', label::VARCHAR, vec_id::VARCHAR, '9')), vec_id) AS anchor FROM embeddings),
c AS (SELECT o.scene, o.vec_id FROM o JOIN o AS a ON a.scene = o.scene AND a.vec_id = o.anchor WHERE abs(o.i - a.i) <= floor(o.n * 0.5 / 2))
SELECT scene, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY md5(concat_ws(':', scene::VARCHAR, vec_id::VARCHAR, '9-near')), vec_id) AS r FROM c) WHERE r <= 5""")
def near_views(t: Tables) -> DataFrame:
    return sampling.near_views(t.embeddings.withColumnRenamed("label", "scene"), "scene", "vec_id", 0.5, 5, 9).select("scene", "vec_id")


@query("""SELECT event_id, round(value / nullif(avg(value) OVER (PARTITION BY user_id), 0), 6) AS scaled FROM events""")
def lengths_by_mean(t: Tables) -> DataFrame:
    return windows.scale_by_mean(t.events, ["user_id"], "value").select("event_id", F.round("scaled", 6).alias("scaled"))


# --- placeholders


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '<video>' || p_type || '<image>' ELSE '<image>' || p_name END AS s, p_size % 4 AS n FROM part)
SELECT p_partkey, CASE WHEN contains(replace(s, '<video>', '<image>'), '<image>') THEN regexp_replace(replace(s, '<video>', '<image>'), '<image>', repeat('<image>', n::BIGINT)) ELSE repeat('<image>', n::BIGINT) || chr(10) || s END AS expanded,
 (length(s) - length(replace(s, '<image>', ''))) // 7 = n AS fits, list_filter(list_concat(['text:' || string_split(s, '<image>')[1]], flatten(list_transform(string_split(s, '<image>')[2:], lambda x: ['image:', 'text:' || x]))), lambda x: x <> 'text:') AS elements FROM p""")
def placeholders(t: Tables) -> DataFrame:
    k = _c("p_size") % 3
    text = F.when(k == 0, _c("p_name")).when(k == 1, F.concat("p_name", F.lit("<video>"), "p_type", F.lit("<image>"))).otherwise(F.concat(F.lit("<image>"), "p_name"))
    p = t.part.select("p_partkey", text.alias("s"), (_c("p_size") % 4).alias("n"))
    images = F.array_repeat(F.lit("x"), _c("n").cast("int"))
    elements = F.transform(conversations.placeholder_elements(_c("s"), 2), lambda e: F.concat(e["type"], F.lit(":"), F.coalesce(e["value"], F.lit(""))))
    return p.select("p_partkey", conversations.expanded_placeholder(_c("s"), _c("n")).alias("expanded"), conversations.placeholders_match(_c("s"), images).alias("fits"), elements.alias("elements"))


# --- reports


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)
SELECT user_id, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'view') AS "view" FROM l GROUP BY user_id HAVING count(v) FILTER (event_type IN ('click', 'view')) = 2""")
def complete_latest(t: Tables) -> DataFrame:
    return metrics.complete_latest(t.events, "user_id", "event_type", "value", "event_id", ["click", "view"])


@query("""SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS mean, count(*) FILTER (n_chars > 1000) AS over FROM documents GROUP BY source""")
def lengths_over(t: Tables) -> DataFrame:
    return lookups.counts_over(t.documents, ["source"], _c("n_chars"), 1000).withColumn("mean", F.round("mean", 6))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '[' || chr(39) || p_name || chr(39) || ', "it' || chr(39) || 's"]' WHEN 1 THEN '[' || chr(39) || 'a' || chr(92) || chr(39) || '"' || chr(92) || 'n' || chr(39) || ', None]' WHEN 2 THEN '[]' ELSE '[' || chr(39) || p_type || chr(39) || ']' END AS listed FROM part""")
def quoted_lists(t: Tables) -> DataFrame:
    k = _c("p_size") % 4
    odd = F.array(F.lit("a'\"\n"), F.lit(None).cast("string"))
    lists = F.when(k == 0, F.array("p_name", F.lit("it's"))).when(k == 1, odd).when(k == 2, F.array().cast("array<string>")).otherwise(F.array("p_type"))
    return t.part.withColumn("l", lists).select("p_partkey", sinks.quoted_list("l").alias("listed"))


@query("""WITH f AS (SELECT 'f' || lpad((o_orderkey // 100)::VARCHAR, 6, '0') AS path, o_orderkey // 100 AS k, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT path, k AS idx, n FROM f WHERE k % 3 <> 0 AND k < 80), b AS (SELECT path, n + 1 AS n FROM f WHERE k % 2 = 0)
SELECT path, idx, n FROM a WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT b.path, a.idx, b.n FROM b JOIN a ON a.path = b.path
UNION ALL SELECT path, (SELECT max(idx) FROM a) + row_number() OVER (ORDER BY path), n FROM b WHERE path NOT IN (SELECT path FROM a)""")
def shard_manifests(t: Tables) -> DataFrame:
    k = F.floor(_c("o_orderkey") / 100)
    files = t.orders.groupBy(F.concat(F.lit("f"), F.lpad(k.cast("string"), 6, "0")).alias("path"), k.alias("idx")).agg(F.count("*").alias("n"))
    old, new = files.filter("idx % 3 <> 0 AND idx < 80"), files.filter("idx % 2 = 0").withColumn("n", _c("n") + 1)
    return lookups.merged_manifests(old, new, "path", "idx").select("path", "idx", "n")
