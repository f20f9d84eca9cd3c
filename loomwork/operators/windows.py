"""Order-dependent computations as window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.ordering import numbered_by


def repeat_mask(df: DataFrame, sample: str, view: str, pos: str) -> DataFrame:
    w = Window.partitionBy(sample, view).orderBy(pos)
    return df.withColumn("repeated", F.row_number().over(w) > 1)


def reference_mask(df: DataFrame, sample: str, view: str, pos: str, refs: int) -> DataFrame:
    """Marks all positions of the first ``refs`` different views of a sample."""
    firsts = df.groupBy(sample, view).agg(F.min(pos).alias("_first"))
    w = Window.partitionBy(sample).orderBy("_first")
    ranked = firsts.withColumn("_rank", F.row_number().over(w)).drop("_first")
    return df.join(ranked, [sample, view]).withColumn("is_ref", F.col("_rank") <= refs).drop("_rank")


def gap_runs(df: DataFrame, group: str, at: str, gap: float, tie: str) -> DataFrame:
    """Numbers runs whose neighbours are at most ``gap`` apart: ``run`` from 0."""
    w = Window.partitionBy(group).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(upto)).drop("_new")


def first_window(df: DataFrame, group: str, at: str, gap: float, size: int, tie: str) -> DataFrame:
    """The first ``size`` neighbouring rows of each group without a gap over ``gap``: (group, start, end, rows)."""
    runs = gap_runs(df, group, at, gap, tie)
    long = runs.groupBy(group, "run").agg(F.count("*").alias("n")).filter(F.col("n") >= size).groupBy(group).agg(F.min("run").alias("run"))
    w = Window.partitionBy(group).orderBy(at, tie)
    kept = runs.join(long, [group, "run"]).withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= size)
    return kept.groupBy(group).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("rows"))


def frame_delta(df: DataFrame, sample: str, pos: str, frame: str) -> DataFrame:
    return df.withColumn("frame_delta", F.lead(frame).over(Window.partitionBy(sample).orderBy(pos)) - F.col(frame))


def coverage_cut(df: DataFrame, group: str, order: list, value: str, ratio: float) -> DataFrame:
    """Rows in order until their sum reaches the ratio of the group's total; the row that reaches it stays."""
    w = Window.partitionBy(group)
    before = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", F.coalesce(before, F.lit(0))).withColumn("_t", F.sum(value).over(w)).filter(F.col("_b") < F.col("_t") * ratio).drop("_b", "_t")


def rolled(df: DataFrame, group: list[str], order: list[str], n: int, name: str = "file_id") -> DataFrame:
    """Numbers files (or shards) of ``n`` rows; a group is spread over ranges of its first order column."""
    return numbered_by(df, order, group, "_rn").withColumn(name, F.floor((F.col("_rn") - 1) / n).cast("int")).drop("_rn")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group in order; a rank limit lets every task cut its rows before they are shuffled."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def scale_by_mean(df: DataFrame, group: list[str], length: str) -> DataFrame:
    """Adds ``scaled``: the length over its group's mean length; null where the mean is 0."""
    return df.withColumn("scaled", F.try_divide(F.col(length), F.avg(length).over(Window.partitionBy(*group))))


def trailing_number(path):
    """The number before the extension, -1 without one."""
    found = F.regexp_extract(path, r"_(\d+)\.\w+$", 1)
    return F.when(found != "", found.cast("bigint")).otherwise(F.lit(-1))


def sorted_megabatch(df: DataFrame, megabatch: list[str], length: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*megabatch).orderBy(F.col(length).desc(), tie)
    return df.withColumn("slot", F.row_number().over(w) - 1)
