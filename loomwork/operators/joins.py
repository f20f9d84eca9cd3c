"""Joins of annotation, time and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.ordering import numbered_by


def with_default(left: DataFrame, right: DataFrame, keys: list[str], right_key: str, value: str, default: Column) -> DataFrame:
    """A value by the first of several keys that the right table knows; else the default.

    Of rows that repeat a right key the greatest value counts, so no left row is repeated.
    """
    out, found = left, []
    once = right.groupBy(right_key).agg(F.max(value).alias(value))
    for i, k in enumerate(keys):
        side = once.select(F.col(right_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(side, F.col(k) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found, default)).drop(*[f"_{c}{i}" for i in range(len(keys)) for c in "kv"])


def not_yet_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys no done row has; null keys are work."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def missing_metrics(log: DataFrame, key: str, metric: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys with the wanted metrics that have no value yet, in the wanted order; complete keys are left out."""
    have = log.filter(F.col(value).isNotNull()).groupBy(key).agg(F.collect_set(metric).alias("_have"))
    keys = log.select(key).distinct().join(have, key, "left")
    names = F.array(*[F.lit(w) for w in wanted])
    lacking = F.when(F.col("_have").isNull(), names).otherwise(F.array_except(names, F.col("_have")))
    return keys.withColumn("missing", lacking).drop("_have").filter(F.size("missing") > 0)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], within: list[str]) -> DataFrame:
    """Rows joined by position inside their groups; without groups by position in the tables, which are numbered in ranges."""
    if not within:
        a, b = numbered_by(left, left_order, number="_p"), numbered_by(right, right_order, number="_p")
        return a.join(b, "_p").drop("_p")
    a = left.withColumn("_p", F.row_number().over(Window.partitionBy(*within).orderBy(*left_order)))
    b = right.withColumn("_p", F.row_number().over(Window.partitionBy(*within).orderBy(*right_order)))
    return a.join(b, [*within, "_p"]).drop("_p")


def nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, tolerance: float, id_column: str) -> DataFrame:
    """Each left row with the right row of its group whose time is nearest, within the tolerance; the earlier of equals.

    Times are cut into buckets of the tolerance's width, and a right row is put
    into its bucket and both neighbours, so it is an equi-join and not a
    comparison of all pairs.  Each group and time is matched once, so rows that
    repeat an id, or have none, keep their own match.  Right columns but the keys
    are prefixed ``r_``; they are null without a match.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(tolerance or 1.0))
    r = right.select(*[F.col(b).alias(f"_{b}") for b in by], *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    own = [c for c in r.columns if c.startswith("r_")]
    r = r.withColumn("_b", F.explode(F.array(*[bucket(f"r_{time}") + i for i in (-1, 0, 1)])))
    times = left.select(*[F.col(b).alias(f"_l{b}") for b in by], F.col(time).alias("_lt")).distinct()
    near = F.abs(F.col("_lt") - F.col(f"r_{time}"))
    on = (bucket("_lt") == F.col("_b")) & (near <= tolerance)
    for b in by:
        on = on & (F.col(f"_l{b}") == F.col(f"_{b}"))
    ties = [F.col(f"r_{time}"), *[F.col(c) for c in own if c != f"r_{time}"][:1]]
    best = Window.partitionBy(*[f"_l{b}" for b in by], "_lt").orderBy(near, *ties)
    kept = times.join(r, on).withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*[f"_l{b}" for b in by], "_lt", *own)
    same = F.col(time) == F.col("_lt")
    for b in by:
        same = same & (F.col(b) == F.col(f"_l{b}"))
    return left.join(kept, same, "left").drop("_lt", *[f"_l{b}" for b in by])


def backward(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row of its group at or before its time, without a join."""
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*by, time, F.struct(F.col(value)).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").withColumn(f"last_{value}", F.col("_last")[value]).drop("_side", "_v", "_last")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; new rows win."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def first_of_each(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_key", "_r")


def updated(df: DataFrame, changes: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Sets a column by key; of several changes for a key the last in order counts, other rows stay."""
    last = changes.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(F.col(column)), order).alias("_v"))
    joined = df.join(last, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(column, F.when(F.col("_v").isNotNull(), F.col("_v")[column]).otherwise(F.col(column))).drop("_k", "_v")


def relations_hold(required: DataFrame, objects: DataFrame, positions) -> DataFrame:
    """(img, ok): whether every pair of the required classes' objects stands as required.

    ``required`` (img, cls, target, relation) names pairs of classes, ``objects``
    (img, cls, box) what was found; ``positions(a, b)`` gives the relations of two
    boxes.  A class that was not found fails its image.  The join is on image and
    class, so only pairs that a requirement names are compared.
    """
    a = objects.select("img", "cls", F.col("box").alias("_a"))
    b = objects.select("img", F.col("cls").alias("target"), F.col("box").alias("_b"))
    pairs = required.join(a, ["img", "cls"], "left").join(b, ["img", "target"], "left")
    ok = F.coalesce(F.array_contains(positions(F.col("_a"), F.col("_b")), F.col("relation")), F.lit(False))
    return pairs.groupBy("img").agg(F.bool_and(ok).alias("ok"))
