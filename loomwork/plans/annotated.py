"""Registered queries of annotation files made of the tables: written to the shared folder, read as mixes, converted; and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.plans.catalog import query
from loomwork.plans.tables import Tables
from loomwork.sources import annotations, shared


def _c(name: str) -> Column:
    return F.col(name)


def _written(t: Tables, lines: DataFrame, name: str, as_array: bool = False) -> str:
    """One file of (k, value) records in order of k: JSON lines, or one JSON array."""
    path = shared.scratch(t.spark, name)
    ordered = lines.coalesce(1).sortWithinPartitions("k").select("value")
    if as_array:
        ordered = lines.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), ",\n").alias("value")).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    ordered.write.text(path)
    return path


def _asked(t: Tables) -> DataFrame:
    """(conv_id, question, answer, turns): turns as human and gpt."""
    turn = F.struct("turn", F.when(_c("role") == "user", "human").when(_c("role") == "assistant", "gpt").otherwise(_c("role")).alias("from"), _c("text").alias("value"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))
    return t.conversations.groupBy("conv_id").agg(turns.alias("turns"), F.max_by("text", F.when(_c("role") == "user", _c("turn"))).alias("last"))


_ASKED = """WITH a AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS question, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id),
o AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS line, count(*) OVER () AS n FROM a)"""


def _names(count: Column, id_: Column, prefix: str = "") -> Column:
    """So many image paths of an id."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(F.lit(prefix), id_.cast("string"), F.lit("/"), i.cast("string"), F.lit(".jpg")))


@query(_ASKED + """, d AS (SELECT *, 'spar_scannetpp_a' AS ds, 'scannetpp' AS scene, '/img' AS root, 2 AS times FROM o UNION ALL SELECT *, 'spar_rxr_b', 'matterport3d', 's3://', 1 FROM o WHERE line < floor(n * 0.5)
 UNION ALL SELECT *, 'spar_structured3d_c', 'structured3d', '/c/', 1 FROM o)
SELECT conv_id::VARCHAR AS id, question, answer, scene AS scene_name, ds AS dataset_name, 'kind ' || conv_id % 3 AS type, json_extract_string('{"deep": {"k": ' || conv_id || '}}', '$.deep') AS deep, (1 + conv_id % 4)::INTEGER AS images,
 CASE root WHEN 's3://' THEN 's3://s3://x/' || conv_id || '/0.jpg' WHEN '/img' THEN '/img/s/' || conv_id || '/0.jpg' ELSE '/abs/' || conv_id || '/0.jpg' END AS first_image, true AS unposed FROM d, range(0, times) WHERE conv_id % 7 <> 5""")
def spar_samples(t: Tables) -> DataFrame:
    """Three data sets of a mix: every line twice, the first half, and all of them; every seventh record has too many images."""
    mix, asked = {}, _asked(t)
    for name, root, prefix, repeat in (("scannetpp_a", "/img", "s/", 2), ("rxr_b", "s3://", "s3://x/", 0.5), ("structured3d_c", "/c/", "/abs/", 2.5)):
        count = F.when(_c("conv_id") % 7 == 5, F.lit(5)).otherwise(1 + _c("conv_id") % 4)
        deep = F.concat(F.lit('{"k": '), _c("conv_id").cast("string"), F.lit("}"))
        record = F.to_json(F.struct(_c("conv_id").alias("id"), _names(count, _c("conv_id"), prefix).alias("image"), F.concat(F.lit("kind "), (_c("conv_id") % 3).cast("string")).alias("type"), _c("turns").alias("conversations"), deep.alias("deep")))
        mix[name] = {"annotation": _written(t, asked.select(_c("conv_id").alias("k"), record.alias("value")), name), "root": root, "repeat_time": repeat}
    config = shared.scratch(t.spark, "mix")
    t.spark.createDataFrame([(json.dumps(mix),)], "value string").coalesce(1).write.text(config)
    good, _ = annotations.samples(annotations.mixed_records(t.spark, annotations.mix_of(t.spark, config)), "spar")
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    deep = F.concat(F.lit('{"k":'), F.get_json_object("metadata", "$.deep.k"), F.lit("}"))
    return good.select(meta("id").alias("id"), "question", "answer", "scene_name", "dataset_name", meta("type").alias("type"), deep.alias("deep"), F.size("image_path").alias("images"), F.get("image_path", F.lit(0)).alias("first_image"), _c("poses").isNull().alias("unposed"))


def _files(t: Tables, root: str, prefix: str = "") -> DataFrame:
    """A listing: of conversation ids that 11 doesn't divide, images 0 and 2."""
    ids = t.conversations.select("conv_id").distinct().filter("conv_id % 11 <> 0")
    return ids.select(F.explode(F.array(F.lit(0), F.lit(2))).alias("i"), "conv_id").select(F.concat(F.lit(f"{root}/{prefix}"), _c("conv_id").cast("string"), F.lit("/"), _c("i").cast("string"), F.lit(".jpg")).alias("path"))


@query(_ASKED + """ SELECT conv_id::VARCHAR AS id, 'mindcube_raw_qa_' || k AS dataset_name, CASE WHEN k = 'chat' THEN question WHEN conv_id % 2 = 0 THEN question ELSE 'asked ' || conv_id END AS question, CASE WHEN k = 'chat' THEN answer ELSE 'told ' || conv_id END AS answer,
 (1 + (conv_id % 4 >= 2)::INTEGER)::INTEGER AS images, CASE WHEN k = 'chat' THEN conv_id::VARCHAR END AS other FROM o, unnest(['chat', 'plain']) t(k) WHERE conv_id % 11 <> 0""")
def mindcube_samples(t: Tables) -> DataFrame:
    """A JSON array of chats and JSON lines with plain fields; a third data set's name lacks what is asked for; images that aren't there are left out."""
    asked = _asked(t)
    count = 1 + _c("conv_id") % 4
    chats = F.to_json(F.struct(_c("conv_id").alias("id"), _names(count, _c("conv_id")).alias("images"), _c("turns").alias("conversations"), _c("conv_id").alias("other")))
    prompt = F.when(_c("conv_id") % 2 == 0, F.coalesce("last", F.lit(""))).otherwise(F.lit(""))
    plain = F.to_json(F.struct(_c("conv_id").alias("id"), _names(count, _c("conv_id")).alias("images"), prompt.alias("input_prompt"), F.concat(F.lit("asked "), _c("conv_id").cast("string")).alias("question"), F.concat(F.lit("told "), _c("conv_id").cast("string")).alias("gt_answer")))
    mix = {
        "raw_qa_chat": {"annotation": _written(t, asked.select(_c("conv_id").alias("k"), chats.alias("value")), "chat", as_array=True), "root": "/m", "repeat_time": 1.0},
        "raw_qa_plain": {"annotation": _written(t, asked.select(_c("conv_id").alias("k"), plain.alias("value")), "plain"), "root": "/m"},
        "cot": {"annotation": "/nowhere", "root": "/m"},
    }
    config = shared.scratch(t.spark, "mix")
    t.spark.createDataFrame([(json.dumps(mix, indent=2),)], "value string").coalesce(1).write.text(config)
    records = annotations.mixed_records(t.spark, annotations.mix_of(t.spark, config, only="raw_qa"))
    good, _ = annotations.samples(records, "mindcube", _files(t, "/m"))
    # a chat whose user says nothing has an empty question, as has an empty prompt without a question
    return good.select(F.get_json_object("metadata", "$.id").alias("id"), "dataset_name", "question", "answer", F.size("image_path").alias("images"), F.get_json_object("metadata", "$.other").alias("other"))


@query("""SELECT conv_id::VARCHAR AS id, 'in ' || conv_id AS question, 'out' AS answer, '3dthinker_10k' AS dataset_name, '/root/a/' || conv_id || '/0.jpg' AS first_image, CASE WHEN conv_id % 2 = 0 THEN 'extra' END AS note FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 11 <> 0""")
def thinker_samples(t: Tables) -> DataFrame:
    """Paths begin with data/, which the listing doesn't have."""
    rows = t.conversations.select("conv_id").distinct()
    note = F.when(_c("conv_id") % 2 == 0, F.lit("extra"))
    record = F.to_json(F.struct(_c("conv_id").alias("idx"), _names(F.lit(2), _c("conv_id"), "data/a/").alias("image_input"), F.concat(F.lit("in "), _c("conv_id").cast("string")).alias("mindcube_input"), F.lit("out").alias("text_output"), F.lit("x").alias("answer"), note.alias("note")))
    path = _written(t, rows.select(_c("conv_id").alias("k"), record.alias("value")), "thinker")
    records = annotations.mixed_records(t.spark, [{"name": "thinker", "annotation": path, "root": "/root/"}])
    good, _ = annotations.samples(records, "3dthinker", _files(t, "/root", "a/"))
    return good.select(F.get_json_object("metadata", "$.id").alias("id"), "question", "answer", "dataset_name", F.get("image_path", F.lit(0)).alias("first_image"), F.get_json_object("metadata", "$.note").alias("note"))


@query(_ASKED + """, b AS (SELECT question AS q, answer AS w, conv_id AS id FROM o WHERE question <> '' OR true)
SELECT kind, id::VARCHAR AS id, CASE kind WHEN 'spld_spatial' THEN CASE WHEN id % 3 = 0 THEN 'where' ELSE 'where' || chr(10) || 'A. left' || chr(10) || 'B. ' || id END WHEN 'spld_grounding' THEN 'find ' || id WHEN 'spld_coldstart' THEN 'think' ELSE q END AS question,
 CASE kind WHEN 'spld_spatial' THEN (id % 5)::VARCHAR WHEN 'spld_grounding' THEN '[{"bbox_2d":[' || id || ',2],"label":"x"}]' WHEN 'spld_coldstart' THEN '<answer>' || id || '</answer>' ELSE w END AS answer,
 CASE kind WHEN 'spld_spatial' THEN 'spld_spatial_video' WHEN 'sensenova_si_geo' THEN 'sensenova_si' ELSE kind END AS dataset_name, CASE kind WHEN 'sensenova_si' THEN 'und' WHEN 'sensenova_si_geo' THEN 'geo' END AS task, CASE WHEN kind LIKE 'spld%' THEN 'video' END AS data_type,
 '/s/' || id || '/0.jpg' AS first_image FROM b, unnest(['spld_spatial', 'spld_grounding', 'spld_coldstart', 'sensenova_si', 'sensenova_si_geo']) t(kind)""")
def image_only_samples(t: Tables) -> DataFrame:
    """Five kinds of records whose images aren't looked up."""
    asked, id_ = _asked(t), _c("conv_id")
    text = id_.cast("string")
    one = F.concat(text, F.lit("/0.jpg")).alias("image")
    options = F.when(id_ % 3 != 0, F.array(F.lit("A. left"), F.concat(F.lit("B. "), text)))
    kinds = {
        "spld_spatial": [id_.alias("question_id"), one, F.lit("where").alias("question"), options.alias("options"), (id_ % 5).alias("answer"), F.lit("video").alias("data_type"), F.lit("count").alias("question_type")],
        "spld_grounding": [id_.alias("question_id"), one, F.concat(F.lit("find "), text).alias("question"), F.array(F.struct(F.array(id_, F.lit(2)).alias("bbox_2d"), F.lit("x").alias("label"))).alias("answer"), F.lit("video").alias("data_type")],
        "spld_coldstart": [id_.alias("question_id"), one, F.lit("think").alias("prompt"), F.concat(F.lit("<answer>"), text, F.lit("</answer>")).alias("solution"), F.lit("video").alias("data_type")],
        "sensenova_si": [id_.alias("id"), one, _c("turns").alias("conversations")],
        "sensenova_si_geo": [id_.alias("id"), one, _c("turns").alias("conversations")],
    }
    out = None
    for kind, fields in kinds.items():
        path = _written(t, asked.select(id_.alias("k"), F.to_json(F.struct(*fields)).alias("value")), kind)
        good, _ = annotations.samples(annotations.mixed_records(t.spark, [{"name": kind, "annotation": path, "root": "/s"}]), kind)
        meta = lambda k: F.get_json_object("metadata", f"$.{k}")
        rows = good.select(F.lit(kind).alias("kind"), meta("id").alias("id"), "question", "answer", "dataset_name", meta("task").alias("task"), meta("data_type").alias("data_type"), F.get("image_path", F.lit(0)).alias("first_image"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_ASKED + """, g AS (SELECT * FROM o WHERE conv_id % 11 <> 0)
SELECT 'vgllm_scan2cap' AS dataset_name, conv_id::VARCHAR AS id, question, answer, 'scannet' AS scene_name, '/v/' || conv_id || '/0.jpg' AS first_image, (1 + (conv_id % 4 >= 2)::INTEGER)::INTEGER AS images, conv_id / 2 AS kept FROM g
UNION ALL SELECT 'vgllm_spar_7m', conv_id::VARCHAR, question, answer, 'scannet', '/v/' || conv_id || '/0.jpg', (1 + (conv_id % 4 >= 2)::INTEGER)::INTEGER, conv_id::DOUBLE FROM g
UNION ALL SELECT 'vgllm_llava_hound', conv_id::VARCHAR, question, answer, 'llava_hound', '/v/llava_hound/frames/' || conv_id || '/0.jpg', 2, NULL FROM g""")
def video_samples(t: Tables) -> DataFrame:
    """Lists of images whose paths lose a part, a JSON text that becomes an object, and a folder whose files are the frames."""
    asked, id_ = _asked(t), _c("conv_id")
    count = 1 + id_ % 4
    turns = _c("turns").alias("conversations")
    box = F.struct((id_ / 2).alias("iou"))
    info = F.concat(F.lit('{"depth": '), id_.cast("string"), F.lit("}"))
    kinds = {
        "vgllm_scan2cap": ([id_.alias("id"), _names(count, id_, "scannet/posed_images/").alias("images"), turns, F.array(box).alias("input_box"), F.array(id_).alias("gt_box"), (id_ / 2).alias("iou"), F.lit("m").alias("metadata"), F.lit(1).alias("left_out")], _files(t, "/v"), "$.iou"),
        "vgllm_spar_7m": ([id_.alias("qid"), _names(count, id_, "spar/").alias("images"), turns, info.alias("spar_info"), F.lit("t").alias("tag")], _files(t, "/v"), "$.spar_info.depth"),
        "vgllm_llava_hound": ([id_.alias("id"), id_.cast("string").alias("video"), F.lit("llava_hound/frames").alias("data_path"), turns], _files(t, "/v", "llava_hound/frames/"), "$.none"),
    }
    out = None
    for kind, (fields, files, kept) in kinds.items():
        path = _written(t, asked.select(id_.alias("k"), F.to_json(F.struct(*fields)).alias("value")), kind)
        good, _ = annotations.samples(annotations.mixed_records(t.spark, [{"name": kind, "annotation": path, "root": "/v"}]), kind, files)
        rows = good.select("dataset_name", F.get_json_object("metadata", "$.id").alias("id"), "question", "answer", "scene_name", F.get("image_path", F.lit(0)).alias("first_image"), F.size("image_path").alias("images"), F.get_json_object("metadata", kept).cast("double").alias("kept"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH s AS (SELECT source AS scene, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE doc_id % 2 = 0 GROUP BY source)
SELECT scene AS scene_name, n::INTEGER AS images, n::INTEGER AS posed, NULL::VARCHAR AS reason FROM s WHERE n BETWEEN 10 AND 60 UNION ALL SELECT scene, NULL, NULL, CASE WHEN n < 10 THEN 'too few images' ELSE 'too many images' END FROM s WHERE n NOT BETWEEN 10 AND 60""")
def folder_samples(t: Tables) -> DataFrame:
    """Scenes as folders of frames: too small and too large ones are rejects."""
    frames = t.documents.filter("doc_id % 2 = 0").groupBy(_c("source").alias("scene")).agg(F.array_sort(F.collect_list(F.concat("source", F.lit("/"), F.lpad(_c("doc_id").cast("string"), 9, "0"), F.lit(".png")))).alias("frames"))
    good, bad = annotations.folder_samples(frames, "re10k", least=10, most=60)
    kept = good.select("scene_name", F.size("image_path").alias("images"), F.size("poses").alias("posed"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("int")
    return kept.unionByName(bad.select(_c("scene").alias("scene_name"), none.alias("images"), none.alias("posed"), "reason"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), w AS (SELECT k, CASE WHEN k % 10 = 1 THEN 'malformed' WHEN k % 10 = 2 THEN 'no images' WHEN k % 10 = 3 THEN 'too many images' END AS reason FROM p WHERE k % 10 <> 4)
SELECT CASE WHEN reason IS NULL THEN 'spar_scannet' ELSE 'scannet' END AS dataset_name, reason, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT 'odd', coalesce(CASE WHEN k % 10 = 1 THEN 'malformed' WHEN k % 10 = 2 THEN 'no images' END, 'no scene'), count(*) FROM p WHERE k % 10 <> 4 GROUP BY ALL""")
def annotation_counts(t: Tables) -> DataFrame:
    """How many records of two data sets are used and why others aren't; blank lines count as nothing."""
    k = _c("p_partkey")
    count = F.when(k % 10 == 3, F.lit(5)).otherwise(F.lit(1))
    good = F.to_json(F.struct(k.alias("id"), F.when(k % 10 == 2, F.array().cast("array<string>")).otherwise(_names(count, k)).alias("image")))
    value = F.when(k % 10 == 1, F.concat(F.lit('{"id": '), k.cast("string"))).when(k % 10 == 4, F.lit("  ")).otherwise(good)
    path = _written(t, t.part.select(k.alias("k"), value.alias("value")), "counted")
    records = annotations.mixed_records(t.spark, [{"name": n, "annotation": path, "root": "/r"} for n in ("scannet", "odd")])
    return annotations.counts(*annotations.samples(records, "spar"))
