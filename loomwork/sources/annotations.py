"""Annotation files of named data sets to unified samples: mixes of files, records, and a converter for every kind of record.

A record is a JSON object; its keys are a map of variants, so no schema has to be
known, and what a converter doesn't take stays as metadata.  A converter is a
:class:`Kind`: where images, question and answer stand and what the sample is
called.  Rows that can't be used go to rejects with a reason: ``malformed``,
``no images``, ``no file`` (none of the images is in the listing), ``no scene``
or ``too many images``; :func:`counts` tells how many of each data set.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.geometry import identity
from loomwork.sources import convert

TURNS = "array<struct<`from`:string,`value`:string>>"
#: The columns of converted samples.
SAMPLE = ("question", "answer", "scene_name", "dataset_name", "image_path", "depth_list", "poses", "intrinsic", "depth_intrinsic", "metadata")
LINE = "dataset_name string, root string, file string, line bigint, value string"


# --- mixes and records


def mix_of(spark: SparkSession, path: str, base: str = "", only: str | None = None) -> list[dict]:
    """A mix file {name: {annotation, root, repeat_time}} as a list; paths are joined to ``base``, ``only`` is a part of the names to keep."""
    text = spark.read.text(path, wholetext=True).first()[0]  # a configuration
    at = lambda p: p if not base or p.startswith("/") or "://" in p else f"{base.rstrip('/')}/{p}"
    return [
        {"name": name, "annotation": at(d["annotation"]), "root": at(d.get("root", "")), "repeat": d.get("repeat_time", 1)}
        for name, d in json.loads(text).items()
        if only is None or only in name
    ]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the records of JSON lines, or the elements of files that hold one JSON array, numbered from 0 in their file.

    Splits of a file are counted, and each line's number is its number in the
    split after the counts before it.  Blank lines are no records.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = spark.read.text(path).select(F.trim("value").alias("value"), file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = rows.filter("value <> ''")
    heads = rows.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("head"))
    arrays = [r["file"] for r in heads.filter(F.col("head").startswith("[")).select("file").collect()]
    plain = rows.filter(~F.col("file").isin(arrays)) if arrays else rows
    counts = plain.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    out = plain.withColumn("inside", inside).join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("inside")).cast("bigint").alias("line"), "value")
    if arrays:
        whole = spark.read.text(arrays, wholetext=True).select(file.alias("file"), F.from_json("value", "array<variant>").alias("items"))
        items = whole.select("file", F.posexplode("items").alias("line", "item"))
        out = out.unionByName(items.select("file", F.col("line").cast("bigint").alias("line"), F.to_json("item").alias("value")))
    return out


def mixed_records(spark: SparkSession, mix: list[dict]) -> DataFrame:
    """The records of a mix (:data:`LINE`): whole copies for a whole repeat over 1, the first share of a file's lines for one under 1.

    A repeat over 1 that isn't an integer changes nothing.
    """
    out = None
    for d in mix:
        one = lines_of(spark, d["annotation"]).withColumns({"dataset_name": F.lit(d["name"]), "root": F.lit(d["root"])})
        times = d.get("repeat", 1)
        if isinstance(times, int) and times > 1:
            one = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")
        elif times < 1:
            sizes = one.groupBy("file").agg(F.count("*").alias("_n"))
            one = one.join(sizes, "file").filter(F.col("line") < F.floor(F.col("_n") * float(times))).drop("_n")
        one = one.select("dataset_name", "root", "file", "line", "value")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], LINE) if out is None else out


# --- reading a record


def _text(key: str) -> Column:
    """A field as text; other JSON values are written as JSON."""
    return F.try_variant_get(F.col("item")[key], "$", "string")


def _or(*keys: str) -> Column:
    """The first of the fields that isn't empty; the empty text without any."""
    return F.coalesce(*[F.nullif(_text(k), F.lit("")) for k in keys], F.lit(""))


def _list(key: str) -> Column:
    """A list of texts, or one text as a list of one."""
    value = F.col("item")[key]
    return F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(value, "$", "string"))))


def _said(who: str) -> Column:
    turns = F.try_variant_get(F.col("item")["conversations"], "$", TURNS)
    return F.coalesce(convert.last_value(turns, who), F.lit(""))


@dataclass(frozen=True)
class Kind:
    """How records of one kind become samples.

    ``keep``: the fields that metadata has beside type and id; None: all but
    ``skip``.  ``rename`` says what those are called.  ``files``: images must be
    in the listing, ``fallback`` is a prefix that may be cut from a path that
    isn't there, ``drop`` a part that paths are written without.  ``frames``: a
    field that names a folder, whose files are the images where there is no list.
    """

    images: tuple[str, ...]
    question: Callable[[], Column]
    answer: Callable[[], Column]
    scene: Callable[[], Column]
    dataset: Callable[[], Column]
    type: Callable[[], Column]
    id: tuple[str, ...] = ("id",)
    keep: tuple[str, ...] | None = None
    skip: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)
    files: bool = False
    fallback: str = ""
    drop: str = ""
    frames: tuple[str, str] | None = None
    posed: bool = True
    most: int = 0


def _named(prefix: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(prefix), "dataset_name")


def _const(text: str) -> Callable[[], Column]:
    return lambda: F.lit(text)


def _spoken(**more) -> dict:
    return {"question": lambda: _said("human"), "answer": lambda: _said("gpt"), **more}


def _typed(default: str = "unknown") -> Callable[[], Column]:
    return lambda: F.coalesce(_text("type"), F.lit(default))


def _spatial(name: str, **more) -> Kind:
    given = {"images": ("image",), "scene": _const("scannet"), "dataset": _const(name), "type": _const(name), "id": ("question_id",), "keep": ("data_type",), **more}
    return Kind(**given)


def _with_options() -> Column:
    options = F.try_variant_get(F.col("item")["options"], "$", "array<string>")
    asked = F.coalesce(_text("question"), F.lit(""))
    return F.when(F.size(options) > 0, F.concat_ws("\n", asked, F.array_join(options, "\n"))).otherwise(asked)


def _grounded(name: str, part: str, keys: tuple[str, ...], scene: str = "scannet", **more) -> Kind:
    first = lambda: F.when(F.contains(F.get("image_path", F.lit(0)), F.lit("llava_hound")), F.lit("llava_hound")).otherwise(F.lit(scene))
    return Kind(("images",), scene=first, dataset=_const(name), type=_const(name), id=("id", "qid"), keep=keys, files=True, drop=part, **_spoken(), **more)


# The data sets, their fields, and what samples of them are called.
SPAR_SCENES = {"rxr": "matterport3d", "scannetpp": "scannetpp", "scannet": "scannet", "structured3d": "structured3d"}
KINDS: dict[str, Kind] = {
    "spar": Kind(
        ("image",), dataset=_named("spar_"), type=_typed(), skip=("image", "conversations", "type", "id"), posed=False, most=4,
        scene=lambda: F.coalesce(*[F.when(F.contains("dataset_name", F.lit(k)), F.lit(v)) for k, v in SPAR_SCENES.items()]), **_spoken(),
    ),
    "mindcube": Kind(
        ("images",), scene=_const("mindcube"), dataset=_named("mindcube_"), type=_typed(), files=True,
        question=lambda: F.when(F.col("item")["conversations"].isNotNull(), _said("human")).otherwise(_or("input_prompt", "question")),
        answer=lambda: F.when(F.col("item")["conversations"].isNotNull(), _said("gpt")).otherwise(_or("gt_answer")),
        skip=("images", "conversations", "input_prompt", "question", "gt_answer", "type", "id"),
    ),
    "3dthinker": Kind(
        ("image_input",), question=lambda: _or("mindcube_input"), answer=lambda: _or("text_output"), scene=_const("3dthinker"), dataset=_const("3dthinker_10k"), type=_const("3dthinker"), id=("idx",),
        skip=("mindcube_input", "mindcube_output", "text_input", "text_output", "image_input", "answer", "idx", "type", "id"), files=True, fallback="data/",
    ),
    "sensenova_si": Kind(("image",), scene=_const("sensenova_si"), dataset=_const("sensenova_si"), type=_const("sensenova_si"), keep=(), extra={"task": "und"}, **_spoken()),
    "sensenova_si_geo": Kind(("image",), scene=_const("sensenova_si"), dataset=_const("sensenova_si"), type=_const("sensenova_si"), keep=(), extra={"task": "geo"}, **_spoken()),
    "spld_spatial": _spatial(
        "spld_spatial", question=_with_options, answer=lambda: _or("answer"), keep=("data_type", "question_type", "options"),
        dataset=lambda: F.concat(F.lit("spld_spatial_"), F.coalesce(_text("data_type"), F.lit("unknown"))),
    ),
    "spld_grounding": _spatial("spld_grounding", question=lambda: _or("question"), answer=lambda: F.coalesce(_text("answer"), F.lit("[]"))),
    "spld_coldstart": _spatial("spld_coldstart", question=lambda: _or("prompt"), answer=lambda: _or("solution")),
    "vgllm_scan2cap": _grounded("vgllm_scan2cap", "scannet/posed_images/", ("metadata", "input_box", "gt_box", "iou")),
    "vgllm_scanrefer": _grounded("vgllm_scanrefer", "scannet/posed_images/", ("metadata", "gt_bbox", "target")),
    "vgllm_scannet_det": _grounded("vgllm_scannet_det", "scannet/posed_images/", ("boxes",)),
    "vgllm_sqa3d": _grounded("vgllm_sqa3d", "scannet/posed_images/", ("situation", "question_type")),
    "vgllm_spar_234k": _grounded("vgllm_spar_234k", "spar/", ("spar_info", "tag")),
    "vgllm_spar_7m": _grounded("vgllm_spar_7m", "spar/", ("spar_info", "tag")),
    "vgllm_llava_hound": _grounded("vgllm_llava_hound", "llava_hound/frames/", (), scene="llava_hound", frames=("video", "data_path")),
}


# --- converting


def _joined(root: Column, path: Column) -> Column:
    """Store paths follow the root as they are, absolute paths stay, others are joined."""
    return (
        F.when(path.startswith("s3://"), F.concat(root, path))
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))
    )


def _present(rows: DataFrame, kind: Kind, files: DataFrame) -> DataFrame:
    """``image_path`` with what the listing has, in order; a path that isn't there is tried without the fallback prefix."""
    known = files.select("path").distinct()
    each = rows.select("_row", "root", F.posexplode("raw").alias("k", "p"))
    tries = F.array(_joined(F.col("root"), F.col("p")))
    if kind.fallback:
        cut = convert.without_prefix(F.col("p"), kind.fallback)
        tries = F.array_distinct(F.array(_joined(F.col("root"), F.col("p")), _joined(F.col("root"), cut)))
    tried = each.select("_row", "k", F.posexplode(tries).alias("n", "path")).join(known, "path", "left_semi")
    best = tried.groupBy("_row", "k").agg(F.min_by("path", "n").alias("path"))
    found = best.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("image_path"))
    return rows.join(found, "_row", "left")


def _frames_of(rows: DataFrame, kind: Kind, files: DataFrame) -> DataFrame:
    """Fills ``raw`` from the files of the folder that a record names, where it has no list of images."""
    folder, middle = kind.frames
    at = F.concat_ws("/", F.regexp_replace("root", "/+$", ""), F.nullif(F.coalesce(_text(middle), F.lit("")), F.lit("")), _text(folder))
    images = files.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).select(F.regexp_replace("path", "/[^/]*$", "").alias("_folder"), "path")
    lists = images.groupBy("_folder").agg(F.array_sort(F.collect_list("path")).alias("_frames"))
    named = rows.withColumn("_at", F.when(F.col("item")["images"].isNull(), at))
    return named.join(lists, F.col("_at") == F.col("_folder"), "left").withColumn("raw", F.coalesce("_frames", "raw")).drop("_at", "_folder", "_frames")


def _metadata(kind: Kind) -> Column:
    """A JSON object of type, id and the fields that are kept; JSON in texts becomes objects."""
    of_id = F.coalesce(*[F.col("item")[k] for k in kind.id], F.lit("").cast("variant"))
    fixed = [F.lit("type"), kind.type().cast("variant"), F.lit("id"), of_id]
    for k, v in kind.extra.items():
        fixed += [F.lit(k), F.lit(v).cast("variant")]
    if kind.keep is None:
        more = F.map_filter("item", lambda k, v: ~k.isin(*kind.skip))
    else:
        more = F.map_filter("item", lambda k, v: k.isin(*kind.keep)) if kind.keep else F.map_filter("item", lambda k, v: F.lit(False))
    return convert.destringified(F.to_json(F.map_concat(F.create_map(*fixed), more)))


def samples(records: DataFrame, name: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of records of a kind.  ``files`` (path) lists what exists, where the kind asks for it.

    Samples have :data:`SAMPLE` with the data set's and the line's place as
    ``source`` (file) and ``line``; rejects have the record's value and a reason.
    """
    kind = KINDS[name]
    parsed = records.withColumn("item", F.from_json("value", "map<string,variant>"))
    raw = F.coalesce(*[F.when(F.size(_list(k)) > 0, _list(k)) for k in kind.images])
    if kind.drop:
        raw = F.transform(raw, lambda p: F.replace(p, F.lit(kind.drop), F.lit("")))
    rows = parsed.withColumn("raw", raw)
    checks = kind.files and files is not None
    if checks:
        rows = rows.withColumn("_row", F.xxhash64("file", "line", "dataset_name", "value"))
        if kind.frames:
            rows = _frames_of(rows, kind, files)
        ids = rows.dropDuplicates(["_row"]).select("_row", "root", "raw")
        rows = rows.join(_present(ids, kind, files).select("_row", "image_path"), "_row", "left").drop("_row")
    else:
        rows = rows.withColumn("image_path", F.transform("raw", lambda p: _joined(F.col("root"), p)))
    marked = rows.withColumn("scene_name", kind.scene())
    rules = {"malformed": F.col("item").isNotNull(), "no images": F.size("raw") > 0}
    if checks:
        rules["no file"] = F.size("image_path") > 0
    rules["no scene"] = F.col("scene_name").isNotNull()
    if kind.most:
        rules["too many images"] = F.size("image_path") <= kind.most
    good, bad = convert.split_rejects(marked, rules)
    pose = identity()
    columns = {
        "question": kind.question(),
        "answer": kind.answer(),
        "_name": kind.dataset(),
        "metadata": _metadata(kind),
        "depth_list": F.array().cast("array<string>") if kind.posed else F.lit(None).cast("array<string>"),
        "poses": F.array_repeat(pose, F.size("image_path")) if kind.posed else F.lit(None).cast("array<array<double>>"),
        "intrinsic": pose if kind.posed else F.lit(None).cast("array<double>"),
        "depth_intrinsic": pose if kind.posed else F.lit(None).cast("array<double>"),
    }
    out = good.withColumns(columns).withColumn("dataset_name", F.col("_name"))
    return out.select(*SAMPLE, F.col("file").alias("source"), "line"), bad.select("dataset_name", "file", "line", "value", "reason")


def folder_samples(folders: DataFrame, name: str, least: int = 2, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of scene folders (scene, frames): the frames of a folder are one sample without question and answer."""
    n = F.size("frames")
    rules = {"no images": n > 0, "too few images": n >= least}
    if most:
        rules["too many images"] = n <= most
    good, bad = convert.split_rejects(folders, rules)
    pose = identity()
    meta = F.to_json(F.struct(F.lit(name).alias("type"), F.col("scene").alias("id"), n.alias("n_frames")))
    local = F.transform("frames", lambda p: F.concat(F.col("scene"), F.lit("/"), F.element_at(F.split(p, "/"), -1)))
    found = good.select(
        F.lit("").alias("question"), F.lit("").alias("answer"), F.col("scene").alias("scene_name"), F.lit(name).alias("dataset_name"), local.alias("image_path"), F.array().cast("array<string>").alias("depth_list"),
        F.array_repeat(pose, n).alias("poses"), pose.alias("intrinsic"), pose.alias("depth_intrinsic"), meta.alias("metadata"),
    )
    return found, bad.select("scene", "reason")


def counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(dataset_name, reason, n): processed samples (reason null) and rejects by reason; the first column is each side's own name."""
    kept = good.groupBy("dataset_name").agg(F.count("*").alias("n")).select("dataset_name", F.lit(None).cast("string").alias("reason"), "n")
    lost = bad.groupBy("dataset_name", "reason").agg(F.count("*").alias("n"))
    return kept.unionByName(lost)
