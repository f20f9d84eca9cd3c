"""Joins of predictions, annotations and files that say what they didn't find, and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that have a partner, one row of counts: left, right, unmatched_left, unmatched_right); null keys have none."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sums = sides.groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    alone = lambda own, other: F.coalesce(F.sum(F.when((F.col(other) == 0) | ~known, F.col(own))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = sums.agg(total("l").alias("left"), total("r").alias("right"), alone("l", "r").alias("unmatched_left"), alone("r", "l").alias("unmatched_right"))
    return left.join(right, keys), counts


def with_predictions(annotations: DataFrame, predictions: DataFrame, key: str, value: str, missing: Column) -> DataFrame:
    """Every annotation with its prediction; one without takes ``missing``, and ``answered`` says so.  Of several predictions the least counts."""
    one = predictions.groupBy(key).agg(F.min(F.col(value)).alias("_v"))
    joined = annotations.join(one, key, "left")
    return joined.withColumn(value, F.coalesce("_v", missing)).withColumn("answered", F.col("_v").isNotNull()).drop("_v")


def own_or_given(answers: DataFrame, truth: DataFrame, key: str, field: str, default: Column | None = None) -> DataFrame:
    """A field of the answers' own where it is there, else the truth's by key; the default, or null, where neither has it."""
    given = truth.groupBy(key).agg(F.min(F.col(field)).alias("_given"))
    return answers.join(given, key, "left").withColumn(field, F.coalesce(field, "_given", *([] if default is None else [default]))).drop("_given")


def of_category(answers: DataFrame, questions: DataFrame, key: str, category: Column) -> DataFrame:
    """Answers whose question is of the category, each once."""
    return answers.join(questions.filter(category).select(key), key, "left_semi")


def that_exist(paths: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Rows whose path is among the files; a listing takes the place of a look-up per row."""
    return paths.join(files.select(path), path, "left_semi")


def membership(df: DataFrame, group: list[str], prediction: Column, answers: Column) -> DataFrame:
    """The share of predictions that are among their answers, in any case; null answers hold none."""
    hit = F.array_contains(F.transform(answers, lambda a: F.lower(a)), F.lower(prediction))
    return df.groupBy(*group).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def totals(files: DataFrame, rows: str, size: str) -> DataFrame:
    """One row: files, rows, size, and the mean rows of a file."""
    return files.agg(F.count("*").alias("files"), F.sum(rows).alias("rows"), F.sum(size).alias("size"), F.avg(rows).alias("mean_rows"))


def in_report_order(report: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows with their place: names of the order first, as it says, then all others by name."""
    known = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    place = F.when(known > 0, known).otherwise(F.lit(len(order) + 1))
    rank = F.row_number().over(Window.orderBy(place, name))  # a report's rows, one a name
    return report.withColumn("place", rank)


def with_extension(files: DataFrame, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """Paths that end in one of the extensions, in any case."""
    return files.filter(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions]))


def within_budget(df: DataFrame, tokens: Column, segments: Column, most: int) -> DataFrame:
    """Adds ``fits``: whether a sample's tokens, with two marks for each segment, are at most ``most``; null tokens don't fit."""
    return df.withColumn("fits", F.coalesce(tokens + 2 * segments <= most, F.lit(False)))


def counts_over(df: DataFrame, group: list[str], value: Column, threshold: float) -> DataFrame:
    """(group, n, total, mean, over): the sum and mean of a count, and the rows in which it is over the threshold."""
    sums = [F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")]
    return df.groupBy(*group).agg(*sums, F.count_if(value > threshold).alias("over"))


def merged_manifests(old: DataFrame, new: DataFrame, name: str, index: str) -> DataFrame:
    """Manifests as one: entries of ``new`` replace those of their name, others go on from the highest index of ``old``.

    An entry's index stays when it is replaced.  New names are numbered in order
    of name; a manifest has one row a shard, so their numbering is one window.
    """
    kept = old.groupBy(name).agg(F.min(index).alias("_i"))
    top = old.agg(F.coalesce(F.max(index), F.lit(-1)).alias("_top"))  # one row
    joined = new.drop(index).join(kept, name, "left").crossJoin(top)
    added = F.row_number().over(Window.partitionBy(F.col("_i").isNull()).orderBy(name)) + F.col("_top")
    entries = joined.withColumn(index, F.coalesce("_i", added).cast(old.schema[index].dataType)).drop("_i", "_top")
    return old.join(new.select(name), name, "left_anti").unionByName(entries, allowMissingColumns=True)


def spread(df: DataFrame, group: list[str], order: str, value: str, reach: float) -> DataFrame:
    """cume_dist, percent_rank, the second value, and the rows whose order lies within ``reach`` of a row's, in its group."""
    w = Window.partitionBy(*group).orderBy(order)
    near = F.expr(f"count(*) OVER (PARTITION BY {', '.join(group)} ORDER BY {order} RANGE BETWEEN {reach:f}D PRECEDING AND {reach:f}D FOLLOWING)")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({
        "cume_dist": F.cume_dist().over(w), "percent_rank": F.percent_rank().over(w),
        "second": F.nth_value(value, 2).over(whole), "near": near,
    })
