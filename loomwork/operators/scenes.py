"""Three-dimensional scenes for question answering: aligned poses, unprojected depth, bounds, and the samples that hold them.

Inputs are tables: scenes (video_id, images, axis_align, depth_cam2img; matrices
are 16 numbers by rows), poses (path, pose) of the text files beside the images,
depths (path, u, v, depth_mm) of the decoded depth images, a row a pixel, and
objects (scene_id, objects).  A scene whose frames lack a pose or a depth image
is rejected with its reason, and so are questions about it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import geometry
from loomwork.functions.expr import bound
from loomwork.sources import convert

# The data set that scenes come from, and the sub-sets whose boxes are kept.
SCENE = "scannet"
BOX_FIELDS = {"scan2cap": "box_input", "scanrefer": "box", "multi3drefer": "box"}


@bound
def product(a: Column, b: Column) -> Column:
    """The product of two 4x4 matrices."""
    at = lambda m, i: F.get(m, F.lit(i))
    return F.array(*[sum((at(a, 4 * r + i) * at(b, 4 * i + c) for i in range(4)), F.lit(0.0)) for r in range(4) for c in range(4)])


def frame_path(image: Column, folder: str, suffix: str | None = None) -> Column:
    """The path of a listed image below the folder of posed images, or of the file with another suffix beside it."""
    start = F.instr(image, f"{SCENE}/")
    bare = F.when(start > 0, F.concat(F.substring(image, F.lit(1), start - 1), F.substring(image, start + len(SCENE) + 1, F.char_length(image)))).otherwise(image)
    path = F.concat(F.lit(folder.rstrip("/") + "/"), bare)
    return path if suffix is None else F.replace(path, F.lit(".jpg"), F.lit(suffix))


def frames(scenes: DataFrame, poses: DataFrame, folder: str) -> DataFrame:
    """(video_id, frame, image_path, depth_path, pose, depth_cam2img): every frame with its pose in the scene's axes; null without one."""
    listed = scenes.select("video_id", "axis_align", "depth_cam2img", F.posexplode("images").alias("frame", "image"))
    named = listed.withColumns({"image_path": frame_path(F.col("image"), folder), "depth_path": frame_path(F.col("image"), folder, ".png"), "_at": frame_path(F.col("image"), folder, ".txt")})
    known = poses.select(F.col("path").alias("_at"), F.col("pose").alias("_pose"))
    aligned = F.when(F.col("_pose").isNotNull(), product(F.col("axis_align"), F.col("_pose")))
    return named.join(known, "_at", "left").select("video_id", "frame", "image_path", "depth_path", aligned.alias("pose"), "depth_cam2img")


def points(framed: DataFrame, depths: DataFrame) -> DataFrame:
    """(video_id, frame, u, v, valid, point): a world point per pixel; pixels without depth aren't valid."""
    pixels = depths.select(F.col("path").alias("depth_path"), "u", "v", "depth_mm")
    both = framed.join(pixels, "depth_path")
    point = geometry.unprojected(F.col("u").cast("double"), F.col("v").cast("double"), F.col("depth_mm").cast("double"), F.col("depth_cam2img"), F.col("pose"))
    return both.select("video_id", "frame", "u", "v", (F.col("depth_mm") > 0).alias("valid"), point.alias("point"))


def bounds(pointed: DataFrame) -> DataFrame:
    """(video_id, boundary): least and greatest x, y and z of the valid points, zeros without any; partial per task, six numbers a scene."""
    at = lambda i: F.when(F.col("valid"), F.get("point", F.lit(i)))
    ends = [F.coalesce(f(at(i)), F.lit(0.0)) for i in range(3) for f in (F.min, F.max)]
    return pointed.groupBy("video_id").agg(F.array(*ends).alias("boundary"))


def world_coords(pointed: DataFrame) -> DataFrame:
    """(video_id, world_coords): a scene's points as one JSON list, by frame and pixel; once a scene, however many items ask about it."""
    item = F.struct("frame", "v", "u", "point")
    return pointed.groupBy("video_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["point"])).alias("world_coords"))


def scene_rows(scenes: DataFrame, poses: DataFrame, depths: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(scenes, rejects): a row a scene with its lists of paths and poses, depth camera and boundary."""
    framed = frames(scenes, poses, folder)
    seen = depths.select(F.col("path").alias("depth_path"), F.lit(True).alias("_depth")).distinct()
    marked = framed.join(seen, "depth_path", "left")
    item = F.struct("frame", "image_path", "depth_path", "pose")
    listed = marked.groupBy("video_id").agg(
        F.sort_array(F.collect_list(item)).alias("f"),
        F.first("depth_cam2img").alias("depth_intrinsic"),
        F.bool_and(F.col("pose").isNotNull()).alias("_posed"),
        F.bool_and(F.col("_depth").isNotNull()).alias("_deep"),
    )
    every = scenes.select("video_id").join(listed, "video_id", "left")
    good, bad = convert.split_rejects(every, {"no images": F.col("f").isNotNull(), "no pose": F.col("_posed"), "no depth": F.col("_deep")})
    field = lambda name: F.transform("f", lambda x: x[name])
    rows = good.select("video_id", field("image_path").alias("image_path"), field("depth_path").alias("depth_list"), field("pose").alias("poses"), "depth_intrinsic")
    return rows.join(bounds(points(framed, depths)), "video_id"), bad.select("video_id", "reason")


def _asked(items: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = items.join(rows, F.col("video") == F.col("video_id"), "left")
    return convert.split_rejects(both, {"no scene": F.col("video_id").isNotNull()})


def _sample(both: DataFrame, dataset: Column, meta: Column, **more: Column) -> DataFrame:
    return both.select(
        F.coalesce(convert.last_value(F.col("conversations"), "human"), F.lit("")).alias("question"),
        F.coalesce(convert.last_value(F.col("conversations"), "gpt"), F.lit("")).alias("answer"),
        F.lit(SCENE).alias("scene_name"), dataset.alias("dataset_name"), "image_path", "poses", geometry.identity().alias("intrinsic"), "depth_intrinsic",
        F.to_json(meta).alias("metadata"), *[c.alias(n) for n, c in more.items()],
    )


def scanqa_samples(items: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (id, video, conversations, answers) about scenes; without a list of answers the one given is it."""
    good, bad = _asked(items, rows)
    said = convert.last_value(F.col("conversations"), "gpt")
    own = F.when(F.coalesce(said, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(said))
    meta = F.struct(F.lit("scanqa").alias("type"), "video_id", F.col("id").alias("qa_id"), F.coalesce("answers", own).alias("answers"))
    return _sample(good, F.lit("scanqa"), meta), bad.select("id", "video", "reason")


def video3d_samples(items: DataFrame, rows: DataFrame, objects: DataFrame, pointed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items (id, video, dataset, conversations, box_input, box) with depth paths, boundary and the scene's objects.

    Objects are looked up by video_id, then by the scene id behind its last
    slash, else there are none.  The points of a scene can be millions; they are
    a table (:func:`points`), and only where ``pointed`` is given does the row
    hold them as JSON, by frame and pixel.  That is a copy an item; where many
    items ask about a scene, join :func:`world_coords` by ``video_id`` instead.
    """
    scene = F.element_at(F.split("video_id", "/"), -1)
    known = objects.groupBy("scene_id").agg(F.first("objects").alias("objects"))
    by_video = known.select(F.col("scene_id").alias("_v"), F.col("objects").alias("_ov"))
    by_scene = known.select(F.col("scene_id").alias("_s"), F.col("objects").alias("_os"))
    with_objects = rows.join(by_video, F.col("video_id") == F.col("_v"), "left").join(by_scene, scene == F.col("_s"), "left")
    with_objects = with_objects.withColumn("objects", F.coalesce("_ov", "_os", F.lit("[]"))).drop("_v", "_s", "_ov", "_os")
    if pointed is not None:
        with_objects = with_objects.join(world_coords(pointed), "video_id", "left")
    else:
        with_objects = with_objects.withColumn("world_coords", F.lit(None).cast("string"))
    good, bad = _asked(items, with_objects)
    kept = lambda field: F.when(F.col("dataset").isin([d for d, f in BOX_FIELDS.items() if f == field]), F.col(field))
    meta = F.struct(F.concat(F.lit("video3dllm_"), "dataset").alias("type"), "id", "video_id", "dataset", kept("box_input").alias("box_input"), kept("box").alias("box"))
    more = {n: F.col(n) for n in ("depth_list", "world_coords", "boundary", "objects")}
    return _sample(good, F.concat(F.lit("video3dllm_"), "dataset"), meta, **more), bad.select("id", "video", "reason")
