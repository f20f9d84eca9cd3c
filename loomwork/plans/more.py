"""Registered queries of parsers, converters, geometry, views and joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import geometry, parsers, vision
from loomwork.operators import conversations, joins, lookups, metrics, ordering, sampling, similarity, windows
from loomwork.plans.catalog import query
from loomwork.plans.tables import Tables
from loomwork.sources import convert


def _c(name: str) -> Column:
    return F.col(name)


# --- parsers


@query("""SELECT conv_id, turn, regexp_replace(replace(replace(lower(replace(replace(replace(replace(text || 'True是' || chr(10) || '不是 False 好', chr(10), ''), '不是', 'No'), '是', 'Yes'), '否', 'No')), 'true', 'yes'), 'false', 'no'), '[一-龥]', '', 'g') AS said,
CASE WHEN len(list_intersect(string_split(replace(string_split(text, '.')[1], ',', ''), ' '), ['No', 'not', 'no'])) > 0 THEN 'no' ELSE 'yes' END AS first_said FROM conversations""")
def yes_no_cleaned(t: Tables) -> DataFrame:
    noisy = F.concat("text", F.lit("True是\n不是 False 好"))
    return t.conversations.select("conv_id", "turn", parsers.clean_yes_no(noisy).alias("said"), parsers.first_sentence_yes_no(_c("text")).alias("first_said"))


@query("""WITH p AS (SELECT p_partkey, p_name || ' Answer: ' || chr(65 + (p_partkey % 4)::INT) || ' then Answer:B Answer : ' || chr(65 + (p_size % 6)::INT) AS s, p_name, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size % 6 < 4 THEN chr(65 + (p_size % 6)::INT) ELSE 'B' END AS last_one, upper(substr(trim('  ' || p_name), 1, 1)) AS first_one,
 CASE WHEN p_size % 3 = 0 THEN 'A' ELSE p_name END AS field, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'A' END AS plain_field FROM p""")
def letters_and_fields(t: Tables) -> DataFrame:
    key = lambda k: F.char((65 + _c(k)).cast("int"))
    p = t.part.withColumns({"a": _c("p_partkey") % 4, "b": _c("p_size") % 6})
    s = F.concat("p_name", F.lit(" Answer: "), key("a"), F.lit(" then Answer:B Answer : "), key("b"))
    fenced = F.when(_c("p_size") % 3 == 0, F.lit("nothing here")).otherwise(F.concat(F.lit('Sure:\n```json\n{"answer": "'), "p_name", F.lit('"}\n```')))
    plain = F.when(_c("p_size") % 2 == 0, F.concat(F.lit('{"answer": "'), _c("p_size").cast("string"), F.lit('"}'))).otherwise(F.lit("{}"))
    return p.select("p_partkey", parsers.last_letter(s).alias("last_one"), parsers.first_letter(F.concat(F.lit("  "), "p_name")).alias("first_one"), parsers.fenced_json_field(fenced).alias("field"), parsers.fenced_json_field(plain).alias("plain_field"))


@query("""SELECT p_partkey, p_type AS category, CASE WHEN p_size % 3 = 0 THEN 'agent-object' WHEN p_size % 3 = 1 THEN 'agent' END AS kind, greatest(len(list_filter(string_split_regex(p_name || ' ' || p_type, '\\s+'), lambda w: w <> '')), 1) AS words,
 ['a/' || p_partkey || '.png', 'b.png'] AS tags, [p_name, 'it'] AS listed, (CASE WHEN substr(lower(p_type), 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END) || lower(p_type) AS one, p_name || (CASE WHEN right(p_name, 2) IN ('ch', 'sh') OR right(p_name, 1) IN ('s', 'x') THEN 'es' ELSE 's' END) AS many FROM part""")
def small_texts(t: Tables) -> DataFrame:
    k = _c("p_size") % 3
    kind = F.when(k == 0, F.lit("AO_x")).when(k == 1, F.lit("A_x")).otherwise(F.lit("B_x"))
    tags = F.concat(F.lit("see <img='a/"), _c("p_partkey").cast("string"), F.lit(".png'> and <img='b.png'>"))
    return t.part.select(
        "p_partkey", parsers.category_of_id(F.concat(F.lit("id_"), "p_type", F.lit("_7"))).alias("category"), parsers.kind_of_type(kind).alias("kind"), parsers.word_length(F.array("p_name", "p_type")).cast("bigint").alias("words"),
        parsers.image_tags(tags).alias("tags"), parsers.text_list(F.concat(F.lit("['"), "p_name", F.lit("', 'it']"))).alias("listed"), parsers.with_article(F.lower("p_type")).alias("one"), parsers.plural(_c("p_name")).alias("many"),
    )


# --- geometry and vision


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id, v[1] AS w, v[2] AS x, v[3] AS y, v[4] AS z, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4]) AS l FROM n)
SELECT vec_id, round(1 - 2 * (y * y + z * z) / (l * l), 6) AS m00, round(2 * (x * y - w * z) / (l * l), 6) AS m01, round(2 * (x * z + w * y) / (l * l), 6) AS m02, round(acos(greatest(-1, least(1, (4 * w * w / (l * l) - 2) / 2))), 5) AS angle, 0.0::DOUBLE AS back FROM q""")
def quaternion_poses(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    zero = F.array(*[F.lit(0.0)] * 3)
    m = geometry.matrix_of_quaternion(F.slice(v, 1, 4))
    still = geometry.pose_of(F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]), zero)
    p = t.embeddings.select("vec_id", m.alias("m"), F.slice(v, 5, 3).alias("at"))
    pose = geometry.pose_of(_c("m"), _c("at"))
    there = geometry.transformed(geometry.pose_inverse(pose), geometry.transformed(pose, _c("at")))
    off = F.sqrt(F.aggregate(F.zip_with(there, "at", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    cell = lambda i: F.round(F.get("m", F.lit(i)), 6)
    angle = F.round(geometry.rotation_angle(geometry.pose_of(_c("m"), zero), still), 5)
    return p.select("vec_id", (cell(0) + 0.0).alias("m00"), (cell(1) + 0.0).alias("m01"), (cell(2) + 0.0).alias("m02"), angle.alias("angle"), (F.round(off, 6) + 0.0).alias("back"))


@query("""SELECT event_id, round((value - 50) * (user_id + 1) / 100, 6) AS x, round((30 - 40) * (user_id + 1) / 100.0, 6) AS y, (user_id + 1)::DOUBLE AS z, round(value, 6) AS u, 30.0::DOUBLE AS v, value < 80 AS seen FROM events""")
def pinhole_round_trip(t: Tables) -> DataFrame:
    k = geometry.intrinsics(F.lit(100.0), F.lit(100.0), F.lit(50.0), F.lit(40.0))
    still = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    depth = (_c("user_id") + 1).cast("double")
    p = t.events.select("event_id", "value", depth.alias("d"), geometry.unprojected(_c("value"), F.lit(30.0), depth * 1000, k, still).alias("p"))
    q = p.withColumn("uvd", geometry.projected(_c("p"), k, still))
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    seen = geometry.is_visible(_c("uvd"), F.lit(80.0), F.lit(60.0), _c("d"))
    return q.select("event_id", at("p", 0).alias("x"), at("p", 1).alias("y"), at("p", 2).alias("z"), at("uvd", 0).alias("u"), at("uvd", 1).alias("v"), seen.alias("seen"))


@query("""SELECT p_partkey, round(greatest(0, p_size - 10 + 1.0) * 21 / ((p_size + 1.0) * 21 + 41 * 21 - greatest(0, p_size - 10 + 1.0) * 21), 6) AS iou, ['left of'] AS stands, [p_size * 0.5, 0.0, 50.0 * 0.5, 20.0 * 2.0]::DOUBLE[] AS scaled, [(round_even(greatest(0, least(p_size, 30)) / 4.0, 0))::BIGINT, 0, 5] AS cell FROM part""")
def boxes(t: Tables) -> DataFrame:
    size = _c("p_size").cast("double")
    a = F.array(F.lit(0.0), F.lit(0.0), size, F.lit(20.0))
    b = F.array(F.lit(10.0), F.lit(0.0), F.lit(50.0), F.lit(20.0))
    far = F.array(size + 1000, F.lit(0.0), size + 1010, F.lit(20.0))
    point = F.array(size, F.lit(-3.0), F.lit(99.0))
    cell = geometry.voxel(point, F.array(*[F.lit(0.0)] * 3), F.array(F.lit(30.0), F.lit(30.0), F.lit(20.0)), 4.0)
    box = F.array(size, F.lit(0.0), F.lit(50.0), F.lit(20.0))
    return t.part.select("p_partkey", F.round(geometry.iou(a, b), 6).alias("iou"), geometry.relative_position(a, far).alias("stands"), geometry.scaled_box(box, F.lit(0.5), F.lit(2.0)).alias("scaled"), cell.alias("cell"))


@query("""WITH d AS (SELECT p_partkey, 16 * (1 + p_size % 5) AS h, 16 * (1 + p_size % 7) AS w FROM part) SELECT p_partkey, list_transform(range(0, (h // 16) * (w // 16)), lambda i: ((i // (w // 16)) * 70 + i % (w // 16))::BIGINT) AS ids FROM d""")
def patch_positions(t: Tables) -> DataFrame:
    ids = vision.positions_extrapolated(16 * (1 + _c("p_size") % 5), 16 * (1 + _c("p_size") % 7), 16, 70)
    return t.part.select("p_partkey", F.transform(ids, lambda i: i.cast("bigint")).alias("ids"))


# --- samples and views


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT user_id, event_id FROM p WHERE (r - 1) % 5 = 0""")
def every_fifth_event(t: Tables) -> DataFrame:
    return sampling.stride_rows(t.events, ["user_id"], ["event_id"], 5).select("user_id", "event_id")


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', lang, doc_id::VARCHAR, '4')), doc_id) AS r FROM documents) WHERE r = 1""")
def one_of_each(t: Tables) -> DataFrame:
    return sampling.pick_one(t.documents, "lang", "doc_id", 4).select("lang", "doc_id")


@query("""SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rn FROM documents""")
def numbered_by_length(t: Tables) -> DataFrame:
    key = F.lpad(_c("n_chars").cast("string"), 12, "0")
    return ordering.numbered(t.documents.withColumn("k", F.md5(F.lit(""))).withColumn("k", key), "k", ["doc_id"]).select("doc_id", "rn")


# --- joins


@query("""SELECT (SELECT count(*) FROM documents) AS "left", (SELECT count(*) FROM labels WHERE doc_id % 3 <> 0) AS "right", (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0)) AS unmatched_left, 0::BIGINT AS unmatched_right""")
def join_counts(t: Tables) -> DataFrame:
    _, counts = lookups.matched(t.documents, t.labels.filter("doc_id % 3 <> 0"), ["doc_id"])
    return counts


@query("""SELECT d.doc_id, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def matched_rows(t: Tables) -> DataFrame:
    rows, _ = lookups.matched(t.documents, t.labels, ["doc_id"])
    return rows.select("doc_id", "source", "quality", "toxic")


@query("""SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, l.doc_id IS NOT NULL AS answered FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def predictions_or_missing(t: Tables) -> DataFrame:
    return lookups.with_predictions(t.documents, t.labels.select("doc_id", "quality"), "doc_id", "quality", F.lit(-1)).select("doc_id", "quality", "answered")


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN lang ELSE CASE WHEN l.doc_id IS NOT NULL THEN 'label ' || l.toxic END END AS answer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def own_or_given(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", F.when(_c("doc_id") % 2 == 0, _c("lang")).alias("answer"))
    truth = t.labels.select("doc_id", F.concat(F.lit("label "), _c("toxic").cast("string")).alias("answer"))
    return lookups.own_or_given(own, truth, "doc_id", "answer").select("doc_id", "answer")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def answers_of_category(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    found = lookups.of_category(lines, t.orders, "o_orderkey", _c("o_orderpriority").startswith("1"))
    return found.select(_c("o_orderkey").alias("l_orderkey"), "l_linenumber")


@query("""SELECT doc_id FROM documents WHERE 'src/' || doc_id || '.txt' IN (SELECT 'src/' || doc_id || '.txt' FROM labels WHERE quality = 1)""")
def paths_that_exist(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src/"), _c("doc_id").cast("string"), F.lit(".txt")).alias("path")
    return lookups.that_exist(t.documents.select("doc_id", path), t.labels.filter("quality = 1").select(path), "path").select("doc_id")


@query("""SELECT p_type, round(avg((p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))::INT), 6) AS accuracy, count(*) AS n FROM part GROUP BY p_type""")
def set_membership(t: Tables) -> DataFrame:
    found = lookups.membership(t.part, ["p_type"], F.upper("p_brand"), F.array(*[F.lit(f"Brand#{i}") for i in (1, 2, 3)]))
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT count(*) AS files, sum(n)::BIGINT AS rows, sum(s)::BIGINT AS size, round(avg(n), 6) AS mean_rows FROM (SELECT source, count(*) AS n, sum(n_chars) AS s FROM documents GROUP BY source)""")
def file_totals(t: Tables) -> DataFrame:
    files = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    return lookups.totals(files, "n", "s").withColumn("mean_rows", F.round("mean_rows", 6))


@query("""WITH r AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang)::INT AS place FROM r""")
def report_order(t: Tables) -> DataFrame:
    return lookups.in_report_order(t.documents.groupBy("lang").agg(F.count("*").alias("n")), "lang", ["fr", "en", "xx"])


@query("""SELECT page_id FROM pages WHERE lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('html', 'jpg')""")
def files_by_extension(t: Tables) -> DataFrame:
    return lookups.with_extension(t.pages, "url", (".HTML", "jpg")).select("page_id")


@query("""SELECT event_id, round(cume_dist() OVER w, 8) AS cume_dist, round(percent_rank() OVER w, 8) AS percent_rank, nth_value(event_id, 2) OVER (PARTITION BY user_id, event_type ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
 count(*) OVER (PARTITION BY user_id, event_type ORDER BY value RANGE BETWEEN 5.0 PRECEDING AND 5.0 FOLLOWING) AS near FROM (SELECT DISTINCT ON (user_id, event_type, value) * FROM events ORDER BY user_id, event_type, value, event_id) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value)""")
def window_spread(t: Tables) -> DataFrame:
    once = t.events.groupBy("user_id", "event_type", "value").agg(F.min("event_id").alias("event_id"))
    found = lookups.spread(once, ["user_id", "event_type"], "value", "event_id", 5.0)
    return found.select("event_id", F.round("cume_dist", 8).alias("cume_dist"), F.round("percent_rank", 8).alias("percent_rank"), "second", "near")


@query("""WITH c AS (SELECT user_id, max_by(value, ts) AS v FROM (SELECT user_id, value, event_id AS ts FROM events WHERE event_type = 'click') GROUP BY user_id) SELECT e.event_id, coalesce(c.v, e.value) AS value FROM events e LEFT JOIN c ON e.user_id = c.user_id""")
def updated_values(t: Tables) -> DataFrame:
    changes = t.events.filter("event_type = 'click'").select("user_id", "value", "event_id")
    return joins.updated(t.events, changes, "user_id", "value", "event_id").select("event_id", "value")


# --- reports


@query("""SELECT p_partkey, CASE WHEN lower(p_type) IN ('small', 'promo') THEN 1.0 ELSE 0.0 END AS hit, round(sqrt(least(p_size, 30) * least(p_partkey % 10, 7, p_size)), 6) AS vie FROM part""")
def exact_and_vie(t: Tables) -> DataFrame:
    hit = metrics.exact_match(F.lower("p_type"), F.array(F.lit("small"), F.lit("promo"))).cast("double")
    number = lambda *x: F.array(*[v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in x])
    vie = metrics.viescore(number(_c("p_size"), 30), number(_c("p_partkey") % 10, 7, _c("p_size")))
    return t.part.select("p_partkey", hit.alias("hit"), F.round(vie, 6).alias("vie"))


# --- converters


@query("""SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM (SELECT page_id, 'a/b/' || page_id || '.png' AS url FROM pages)""")
def path_stems(t: Tables) -> DataFrame:
    return t.pages.select("page_id", convert.stem(F.concat(F.lit("a/b/"), _c("page_id").cast("string"), F.lit(".png"))).alias("stem"))


@query("""SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) AS first_value FROM conversations GROUP BY conv_id""")
def conversation_values(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", _c("role").alias("from"), _c("text").alias("value")))), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("c"))
    return turns.select("conv_id", convert.last_value(_c("c"), "user").alias("q"), convert.value_at(_c("c"), 0).alias("first_value"))


@query("""SELECT lang, kept, skipped FROM (SELECT lang, count(*) FILTER (n_chars BETWEEN 500 AND 3000) AS kept, count(*) FILTER (n_chars NOT BETWEEN 500 AND 3000) AS skipped FROM documents GROUP BY lang)""")
def split_rejects(t: Tables) -> DataFrame:
    good, bad = convert.split_rejects(t.documents, {"short": _c("n_chars") >= 500, "long": _c("n_chars") <= 3000})
    both = good.select("lang", F.lit(1).alias("k")).unionByName(bad.select("lang", F.lit(0).alias("k")))
    return both.groupBy("lang").agg(F.sum("k").alias("kept"), F.count_if(_c("k") == 0).alias("skipped"))


# --- windows, similarity


@query("""WITH c AS (SELECT label, vec_id % 4 AS box, vec_id % 100 / 100.0 + vec_id / 1e6 AS score FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC) AS r FROM c WHERE score > 0.3)
SELECT label::VARCHAR AS img, round(max(score), 6) AS score FROM k WHERE r <= 16 GROUP BY label, box""")
def suppressed_boxes(t: Tables) -> DataFrame:
    at = (_c("vec_id") % 4) * 100.0
    found = t.embeddings.select(_c("label").cast("string").alias("img"), F.lit("c").alias("cls"), (_c("vec_id") % 100 / 100.0 + _c("vec_id") / 1e6).alias("score"), F.array(at, at, at + 9, at + 9).alias("box"))
    return similarity.suppressed(found).select("img", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey, 'Be brief.' || chr(10) || 'One letter.' || chr(10) || 'What?' || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_type AS prompt, [p_name, p_type] AS two FROM part""")
def lettered_prompts(t: Tables) -> DataFrame:
    prompt = conversations.prompt("Be brief.", "One letter.", F.lit("What?"), F.array("p_name", "p_type"))
    return t.part.select("p_partkey", prompt.alias("prompt"), conversations.two_options(F.concat(F.lit("(a) "), "p_name", F.lit(" (b) "), "p_type")).alias("two"))


@query("""SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '([0-9]+)[^0-9/]*$', 1) AS BIGINT), -1) AS n FROM (SELECT page_id, 'f/frame_' || page_id || '.png' AS url FROM pages)""")
def trailing_numbers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(windows.trailing_number(F.concat(F.lit("f/frame_"), _c("page_id").cast("string"), F.lit(".png"))).cast("bigint"), F.lit(-1)).alias("n"))
