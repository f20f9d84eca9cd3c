"""Sequence plans: a row per segment of a sample, with its split, its tokens and the positions it takes.

A text segment has its tokens, and one more that ends it if it is trained on; an
image has a start mark, a token for every 2 x 2 patches of its grid, and an end
mark.  Positions go on by a text's tokens; an image takes one for each mark and
between them the greatest side of its merged grid, so its tokens share positions.
Dropped segments (dropout of conditions) have no tokens; a dropped image still
takes one position.  Frames of a clip form one split, other segments one each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a plan needs of each segment; clip and frame are null outside clips.
SEGMENTS = "sample bigint, seg int, kind string, length bigint, grid struct<t:int,h:int,w:int>, loss boolean, dropped boolean, clip int, frame int"
MERGE = 2


def plan(segments: DataFrame) -> DataFrame:
    """Segments with split_start, split_end, frame_delta, split, split_tokens, tokens, start, position, advance and mode.

    ``start`` counts tokens and ``position`` positions in the sample; ``mode`` is
    how a split's tokens see each other: causal in texts, full in images.
    """
    text = F.col("kind") == "text"
    grid = [F.col("grid.t"), F.floor(F.col("grid.h") / MERGE), F.floor(F.col("grid.w") / MERGE)]
    kept = F.when(text, F.col("length") + F.when(F.col("loss"), F.lit(1)).otherwise(F.lit(0))).otherwise(grid[0] * grid[1] * grid[2] + 2)
    tokens = F.when(F.col("dropped"), F.lit(0)).otherwise(kept)
    step = F.when(text, tokens).when(F.col("dropped"), F.lit(1)).otherwise(F.greatest(*grid) + 2)
    order = Window.partitionBy("sample").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sized = segments.withColumns({"tokens": tokens.cast("bigint"), "advance": step.cast("bigint")})
    placed = sized.withColumns({
        "start": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
        "position": F.coalesce(F.sum("advance").over(before), F.lit(0)),
        "_last": F.lag("clip").over(order),
        "_next": F.lead("clip").over(order),
        "_frame": F.lead("frame").over(order),
    })
    same_as = lambda other: F.coalesce(F.col("clip") == F.col(other), F.lit(False))
    marked = placed.withColumns({"split_start": ~same_as("_last"), "split_end": ~same_as("_next"), "frame_delta": F.when(same_as("_next"), F.col("_frame") - F.col("frame"))})
    split = F.sum(F.col("split_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = marked.withColumn("split", split.cast("int")).drop("_last", "_next", "_frame")
    whole = numbered.withColumn("split_tokens", F.sum("tokens").over(Window.partitionBy("sample", "split")))
    return whole.withColumn("mode", F.when(text, F.lit("causal")).otherwise(F.lit("full")))


def lengths(planned: DataFrame) -> DataFrame:
    """(sample, tokens): what a packer needs to know of each sample."""
    return planned.groupBy("sample").agg(F.sum("tokens").alias("tokens"))


def in_bins(planned: DataFrame, places: DataFrame) -> DataFrame:
    """The plan of packed samples with (shard, bin), and ``start`` counted in the bin; positions begin anew in every sample."""
    packed = places.filter("state = 'packed'").select("shard", "bin", F.col("id").alias("sample"), F.col("start").alias("_from"))
    return planned.join(packed, "sample").withColumn("start", F.col("start") + F.col("_from")).drop("_from")
