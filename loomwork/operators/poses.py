"""Camera poses compared by rotation and translation: nearest poses of a scene, and samples of poses near a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import geometry
from loomwork.operators.ordering import order_key

#: Frames of a scene that one block of another meets at a time, and into how many blocks a scene is cut before its blocks grow to that.
BLOCK = 2048
BLOCKS = 8
#: Distances that a task holds at a time.
CELLS = 1 << 20
#: Decimals that distances are compared at; of equals the lower frame comes first.
PLACES = 9


def translation(pose: Column) -> Column:
    return F.array(*[F.get(pose, F.lit(i)) for i in (3, 7, 11)])


def pose_distance(a: Column, b: Column, weight: float = 1.0) -> Column:
    """The rotation between two 4x4 poses as a share of a half turn, plus the weighted distance of their translations."""
    turn = geometry.rotation_angle(a, b) / F.pi()
    return turn + F.lit(weight) * F.sqrt(geometry.squared_distance(translation(a), translation(b)))


def scaled(frames: DataFrame, scene: str, pose: str) -> DataFrame:
    """Poses whose translations are divided by their mean length in the scene; a scene that doesn't move stays as it is."""
    length = geometry.norm(translation(F.col(pose)))
    means = frames.groupBy(scene).agg(F.avg(length).alias("_mean"))
    size = F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(F.lit(1.0))
    moved = F.transform(F.col(pose), lambda x, i: F.when(i.isin(3, 7, 11), x / size).otherwise(x))
    return frames.join(means, scene).withColumn(pose, moved).drop("_mean")


def block_count(frames: Column, block: int) -> Column:
    """Into how many blocks so many frames are dealt."""
    size = F.greatest(F.lit(block), F.least(F.ceil(frames / BLOCKS), F.lit(BLOCK)))
    return F.ceil(frames / size).cast("int")


def nearest_poses(frames: DataFrame, scene: str, frame: str, pose: str, k: int, weight: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(scene, ref, id, distance, rank): the ``k`` frames of its scene that are nearest to each frame, itself left out.

    Frames are dealt to hash blocks of their scene; a pair of blocks is two
    matrix products, of the rotations and of the translations, and only the best
    ``k`` of each reference leave it, so no scene is held by one task.  Every
    frame is sent once a block, so ``block`` is the least size only: the blocks of
    a large scene grow to ``BLOCK`` frames.
    """
    ready = scaled(frames.select(scene, frame, pose), scene, pose)
    blocks = ready.groupBy(scene).agg(block_count(F.count("*"), block).alias("_n"))
    dealt = ready.join(blocks, scene).withColumn("_b", F.pmod(F.xxhash64(frame), F.col("_n").cast("bigint")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = dealt.select(F.col(scene).alias("scene"), F.col("_b").alias("qb"), others.alias("bb"), F.lit(0).alias("side"), F.col(frame).cast("bigint").alias("id"), F.col(pose).alias("pose"))
    right = dealt.select(F.col(scene).alias("scene"), others.alias("qb"), F.col("_b").alias("bb"), F.lit(1).alias("side"), F.col(frame).cast("bigint").alias("id"), F.col(pose).alias("pose"))

    def least(far: np.ndarray, refs: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        """(ref, id, distance): the ``k`` least of every row; of equals the first columns."""
        n = min(k, far.shape[1])
        edge = np.partition(far, n - 1, axis=1)[:, n - 1]
        row, column = np.nonzero(far <= edge[:, None])  # all that tie with the last one, too
        near = far[row, column]
        order = np.lexsort((column, near, row))
        row, column, near = row[order], column[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < n
        return pd.DataFrame({"ref": refs[row[kept]], "id": ids[column[kept]], "distance": near[kept]})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = (pdf[pdf["side"] == s].sort_values("id") for s in (0, 1))
        if q.empty or d.empty:
            return pd.DataFrame({"scene": [], "ref": [], "id": [], "distance": []}).astype({"ref": "int64", "id": "int64"})
        a, b = (np.stack(s["pose"].to_numpy()).reshape(-1, 4, 4) for s in (q, d))
        qi, di = q["id"].to_numpy(), d["id"].to_numpy()
        turns, tb = np.ascontiguousarray(b[:, :3, :3].reshape(-1, 9).T), b[:, :3, 3]
        step, parts = max(1, CELLS // len(b)), []
        for at in range(0, len(a), step):
            rows, ids = a[at : at + step], qi[at : at + step]
            trace = rows[:, :3, :3].reshape(-1, 9) @ turns
            far = np.arccos(np.clip((trace - 1) / 2, -1, 1)) / np.pi
            apart = sum((rows[:, i, 3][:, None] - tb[:, i][None]) ** 2 for i in range(3))
            far += weight * np.sqrt(apart)
            far = np.round(far, PLACES)
            far[ids[:, None] == di[None]] = np.inf
            parts.append(least(far, ids, di))
        out = pd.concat(parts)
        out.insert(0, "scene", pdf["scene"].iloc[0])
        return out[np.isfinite(out["distance"])]

    kind = frames.schema[scene].dataType.simpleString()
    found = left.unionByName(right).groupBy("scene", "qb", "bb").applyInPandas(best, f"scene {kind}, ref bigint, id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("scene", "ref").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("scene", scene)


def near_pose_sample(frames: DataFrame, scene: str, frame: str, pose: str, total: int, expand: float, seed, most: int | None = None, weight: float = 1.0) -> DataFrame:
    """(scene, place, frame): a hashed reference of each scene, then ``total - 1`` hashed draws, with replacement, from the poses nearest to it.

    The nearest are ``2 * expand * total`` of them (at most ``most``, and at most
    the scene), the reference itself among them.  Every frame meets one reference
    only; the ranking is a top-n aggregate of its scene.
    """
    reach = int(total * expand * 2) if most is None else min(most, int(total * expand * 2))
    ready = scaled(frames.select(scene, frame, pose), scene, pose)
    picked = ready.groupBy(scene).agg(F.min_by(F.struct(F.col(frame).alias("frame"), F.col(pose).alias("pose")), F.struct(order_key(seed, scene, frame), F.col(frame))).alias("_ref"))
    far = F.round(F.when(F.col(frame) == F.col("_ref.frame"), F.lit(-1.0)).otherwise(pose_distance(F.col("_ref.pose"), F.col(pose), weight)), PLACES)
    against = ready.join(picked, scene).select(scene, F.col(frame).alias("_f"), far.alias("_far"))
    rank = F.row_number().over(Window.partitionBy(scene).orderBy("_far", "_f"))
    near = against.withColumn("_rank", rank).filter(F.col("_rank") <= reach)
    lists = near.groupBy(scene).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_f"))), lambda x: x["_f"]).alias("_near"))  # at most ``reach``
    places = lists.select(scene, "_near", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("place"))
    draw = F.conv(F.substring(order_key(seed, scene, "place"), 1, 8), 16, 10).cast("bigint") % F.size("_near")
    at = F.when(F.col("place") == 0, F.lit(0)).otherwise(draw).cast("int")
    return places.select(scene, "place", F.get("_near", at).alias(frame))
