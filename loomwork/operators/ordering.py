"""Deterministic random order, and row numbers that don't meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of an order key that name its range: 4096 ranges.
RANGE_DIGITS = 3


def order_key(seed, *columns: str) -> Column:
    """A uniform hex key; sorting by it is a shuffle that any engine repeats."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))).cast("binary"))


def hashed(*parts: Column) -> Column:
    """A whole number under 2^32 by md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(key: Column) -> Column:
    """A number in [0, 1) of a hex key's first 8 digits."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def numbered(df: DataFrame, key: str, ties: list[str], within: list[str] | None = None, number: str = "rn") -> DataFrame:
    """Row numbers from 1 in order of a hex ``key`` and ``ties``, within groups or over all rows.

    The key's first digits cut every group into ranges that are counted, numbered
    each on its own, and shifted by the counts before them; so a group, or the
    whole table, is spread over as many tasks as there are ranges.
    """
    within = within or []
    parted = df.withColumn("_range", F.substring(key, 1, RANGE_DIGITS))
    counts = parted.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(key, *ties))
    keys = [*within, "_range"]
    right = offsets.select(*[F.col(k).alias(f"_{k}") for k in keys], "_before")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = parted.withColumn("_local", local).join(right, same)
    return out.withColumn(number, F.col("_local") + F.col("_before")).drop("_local", "_before", "_range", *[f"_{k}" for k in keys])


def counted(df: DataFrame, within: list[str] | None = None, name: str = "n") -> DataFrame:
    """Adds the rows' number, of the table or of each group."""
    if not within:
        return df.crossJoin(df.agg(F.count("*").alias(name)))  # one row
    return df.join(df.groupBy(*within).agg(F.count("*").alias(name)), within)


#: Ranges that an order of any column is cut into, and rows that are looked at for their bounds.
RANGES = 256
BOUND_ROWS = 8192
STEP = 16


def in_ranges(df: DataFrame, column: str, name: str = "_range") -> DataFrame:
    """Adds the number of the range that a value of the column lies in, -1 for nulls; greater values never lie in earlier ranges.

    Ranges are cut at values of a hashed sample of the column's distinct values,
    of which the driver holds ``BOUND_ROWS`` at most; how many values there are
    is estimated.  A value is looked for among every ``STEP``-th bound and then
    among the bounds behind the one found.
    """
    key = F.col(column)
    values = df.select(key.alias("v")).filter("v is not null")
    share = F.lit(max(1, values.agg(F.approx_count_distinct("v")).first()[0] // (BOUND_ROWS // 2)))
    some = sorted(r["v"] for r in values.filter(F.pmod(F.xxhash64("v"), share) == 0).distinct().limit(BOUND_ROWS).collect())
    bounds = some[:: max(1, len(some) // RANGES)]
    place = F.lit(0)
    if bounds:
        kind = df.schema[column].dataType
        array = lambda some: F.array(*[F.lit(b).cast(kind) for b in some])
        upto = lambda some: F.size(F.filter(some, lambda b: b <= key))
        steps = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)]
        coarse = upto(array([s[0] for s in steps]))
        fine = upto(F.get(F.array(*[array(s) for s in steps]), F.col("_step") - 1))
        place = F.when(F.col("_step") == 0, F.lit(0)).otherwise((F.col("_step") - 1) * STEP + fine)
        df = df.withColumn("_step", F.when(key.isNotNull(), coarse))
    return df.withColumn(name, F.when(key.isNull(), F.lit(-1)).otherwise(place)).drop("_step")


def numbered_by(df: DataFrame, order: list[str], within: list[str] | None = None, number: str = "rn") -> DataFrame:
    """Row numbers from 1 in order of columns of any kind, within groups or over all rows, without a task that holds a group.

    The first order column is cut into ranges, which are counted, numbered each on
    its own, and shifted by the counts before them.  Where the ranges' bounds lie
    changes no number.  Nulls come first.
    """
    within = within or []
    parted = in_ranges(df, order[0])
    counts = parted.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*order))
    keys = [*within, "_range"]
    right = offsets.select(*[F.col(k).alias(f"_{k}") for k in keys], "_before")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = parted.withColumn("_local", local).join(right, same)
    return out.withColumn(number, F.col("_local") + F.col("_before")).drop("_local", "_before", "_range", *[f"_{k}" for k in keys])
