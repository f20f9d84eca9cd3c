"""Shards, mixtures, repeats, megabatches and frame samples."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.expr import let
from loomwork.operators.ordering import counted, hashed, numbered, numbered_by, order_key, uniform


def shuffled(df: DataFrame, key: str, seed) -> DataFrame:
    """A global deterministic shuffle: its position from 1 as ``rn``."""
    return numbered(df.withColumn("_k", order_key(seed, key)), "_k", [key]).drop("_k")


def shards(df: DataFrame, key: str, seed, world: int, how: str) -> DataFrame:
    """Adds ``shard``: floor (rest dropped), stride, balanced (the first n % world get one more) or ceil chunks."""
    placed = counted(shuffled(df, key, seed))
    at, n = F.col("rn") - 1, F.col("n")
    if how == "stride":
        shard = F.pmod(at, F.lit(world))
    elif how == "floor":
        size = F.floor(n / world)
        placed = placed.filter(at < size * world)
        shard = F.floor(at / size)
    elif how == "ceil":
        shard = F.floor(at / F.ceil(n / world))
    elif how == "balanced":
        small, more = F.floor(n / world), n % world
        edge = more * (small + 1)
        shard = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    else:
        raise ValueError(how)
    return placed.withColumn("shard", shard.cast("int")).drop("n")


def worker_lists(sharded: DataFrame, workers: int) -> DataFrame:
    """Each shard's rows in equal runs for its workers (rest dropped), each run reversed: ``worker``, ``pos``."""
    own = sharded.join(sharded.groupBy("shard").agg(F.count("*").alias("_n"), F.min("rn").alias("_first")), "shard")
    size, at = F.floor(F.col("_n") / workers), F.col("rn") - F.col("_first")
    kept = own.filter(at < size * workers)
    return kept.withColumn("worker", F.floor(at / size).cast("int")).withColumn("pos", (size - 1 - at % size).cast("int")).drop("_n", "_first")


def mixture(df: DataFrame, key: str, seed, groups: list[tuple[str, float]]) -> DataFrame:
    """Draws a group for each row: the first whose cumulative weight is over a uniform number of its key."""
    total, cum, out = sum(w for _, w in groups), 0.0, None
    u = uniform(order_key(seed, key))
    for name, weight in groups[:-1]:
        cum += weight / total
        out = F.when(u < F.lit(cum), F.lit(name)) if out is None else out.when(u < F.lit(cum), F.lit(name))
    return df.withColumn("group", F.lit(groups[-1][0]) if out is None else out.otherwise(F.lit(groups[-1][0])))


def repeated(df: DataFrame, group: str, order: str, ratio: Column, variant: str = "b") -> DataFrame:
    """Copies and prefixes of each group by its ratio; ``copy`` counts from 0.

    a: whole numbers above 1 repeat, below 1 a prefix stays, other numbers do
    nothing.  b: whole copies and then a prefix for the fraction.  c: whole
    numbers only, others are an error.
    """
    placed = counted(numbered_by(df, [order], [group], "_o"), [group], "_n").withColumn("_r", ratio.cast("double"))
    r, whole = F.col("_r"), F.floor(F.col("_r"))
    if variant == "a":
        is_whole = r == whole
        times = F.when((r > 1) & is_whole, whole).otherwise(F.lit(1))
        kept = placed.filter((r >= 1) | (F.col("_o") <= F.floor(F.col("_n") * r)))
    elif variant == "b":
        more = F.col("_o") <= F.floor(F.col("_n") * (r - whole))
        times = whole + F.when(more, F.lit(1)).otherwise(F.lit(0))
        kept = placed.filter((whole > 0) | more)
    elif variant == "c":
        times = F.when(r == whole, whole).otherwise(F.raise_error(F.lit("repeat must be a whole number")).cast("bigint"))
        kept = placed
    else:
        raise ValueError(variant)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint") - 1))).drop("_o", "_n", "_r")


def megabatches(df: DataFrame, task: str, key: str, seed, size: int, drop_last: bool = False) -> DataFrame:
    """Tasks shuffled on their own and cut into megabatches, which are shuffled: ``megabatch``, ``mb_order``, ``rn``.

    With ``drop_last`` a task of several megabatches loses its last one.
    """
    placed = numbered(df.withColumn("_k", order_key(seed, key)), "_k", [key], [task]).drop("_k")
    cut = placed.withColumn("megabatch", F.floor((F.col("rn") - 1) / size).cast("int"))
    if drop_last:
        tops = cut.groupBy(task).agg(F.max("megabatch").alias("_top"))
        cut = cut.join(tops, task).filter((F.col("_top") == 0) | (F.col("megabatch") < F.col("_top"))).drop("_top")
    return cut.withColumn("mb_order", order_key(seed, task, "megabatch"))


def even_chunks(df: DataFrame, megabatch: list[str], length: str, key: str, chunks: int) -> DataFrame:
    """Deals each megabatch's rows, longest first, to ``chunks``: always to the chunk of the least length that isn't full.

    A megabatch whose rows don't divide evenly is dealt in turns.  Adds ``chunk``
    and ``slot``; megabatches are of bounded size, so one task holds one.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        placed = pdf.sort_values([length, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        room, rest = divmod(len(placed), chunks)
        if rest:
            placed["chunk"] = placed.index % chunks
        else:
            open_ = [(0.0, c, room) for c in range(chunks)]  # a heap: (length so far, chunk, places left)
            dealt = []
            for x in placed[length]:
                total, c, left = heapq.heappop(open_)
                dealt.append(c)
                if left > 1:
                    heapq.heappush(open_, (total + x, c, left - 1))
            placed["chunk"] = dealt
        placed["slot"] = placed.groupby("chunk").cumcount()
        return placed

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "chunk int", "slot int"])
    return df.groupBy(*megabatch).applyInPandas(deal, schema)


def bernoulli(df: DataFrame, key: str, seed, p: float) -> DataFrame:
    """Keeps rows whose uniform number is at least ``p``: dropout by key."""
    return df.filter(uniform(order_key(seed, key)) >= p)


def pick_one(df: DataFrame, group: str, key: str, seed) -> DataFrame:
    """One row of each group, the least by a hash of its key."""
    return pick_some(df, group, key, seed, 1)


def pick_some(df: DataFrame, group: str, key: str, seed, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order_key(seed, group, key), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def cycled(df: DataFrame, order: str, n: int) -> DataFrame:
    """Exactly ``n`` rows: the rows in order, again and again; none from an empty table.  ``i`` counts from 0."""
    placed = counted(numbered_by(df, [order], number="_i").withColumn("_i", F.col("_i") - 1))
    copies = F.sequence(F.col("_i").cast("bigint"), F.lit(n - 1).cast("bigint"), F.col("n"))
    return placed.filter(F.col("_i") < n).withColumn("i", F.explode(copies)).drop("_i", "n")


def linspace_rows(df: DataFrame, group: list[str], order: list[str], n: int, how: str = "ends") -> DataFrame:
    """``n`` evenly spaced rows of each group: ``ends`` from first to last, ``starts`` at i * N / n; all of smaller groups."""
    w = Window.partitionBy(*group)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = (F.col("_n") - 1) / F.lit(max(1, n - 1)) if how == "ends" else F.col("_n") / F.lit(n)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * step))
    return placed.filter((F.col("_n") <= n) | F.array_contains(wanted, F.col("_i").cast("bigint"))).drop("_i", "_n")


def stride_rows(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w) - 1).filter(F.pmod("_i", F.lit(k)) == 0).drop("_i")


def frame_indices(frames: int, length: Column, how: str = "middle", key: Column | None = None, start: int | None = None, fps: float = 1.0, most: int = -1) -> Column:
    """Frame numbers of a clip: interval middles, fixed offsets or hashed picks, padded with the last; or at ``fpsX``."""
    if how.startswith("fps"):
        delta = 1 / float(how[3:])
        count = F.ceil(length / fps / delta)
        found = F.filter(
            F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0))), lambda i: F.rint((i * delta + delta / 2) * fps).cast("int")),
            lambda x: x < length,
        )
        return F.slice(found, 1, most) if most > 0 else found
    n = F.least(F.lit(frames), length)
    edge = lambda i: F.floor(i * length / n)
    if how == "middle" and start is not None:
        at = lambda i: edge(i) + start
    elif how == "middle":
        at = lambda i: F.floor((edge(i) + edge(i + 1) - 1) / 2)
    else:
        span = lambda i: F.greatest(edge(i + 1) - 1 - edge(i), F.lit(1))
        at = lambda i: edge(i) + hashed(key, i) % span(i)
    found = F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: at(i).cast("int"))
    pad = F.array_repeat(F.element_at(found, -1), (F.lit(frames) - n).cast("int"))
    return F.concat(found, pad)


def stratified_views(df: DataFrame, scene: str, view: str, strata: int, seed) -> DataFrame:
    """One hashed view of each of ``strata`` equal runs of a scene's views."""
    w = Window.partitionBy(scene)
    placed = df.withColumn("_s", F.floor((F.row_number().over(w.orderBy(view)) - 1) * strata / F.count("*").over(w)))
    pick = Window.partitionBy(scene, "_s").orderBy(order_key(seed, scene, view), view)
    return placed.withColumn("_r", F.row_number().over(pick)).filter("_r = 1").drop("_r", "_s")


def near_views(df: DataFrame, scene: str, view: str, share: float, n: int, seed) -> DataFrame:
    """``n`` hashed views within ``share`` of the scene's length around a hashed anchor."""
    w = Window.partitionBy(scene)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(view))).withColumn("_n", F.count("*").over(w))
    anchor = F.min_by("_i", F.struct(order_key(seed, scene, view), F.col(view))).over(w)
    close = placed.withColumn("_a", anchor).filter(F.abs(F.col("_i") - F.col("_a")) <= F.floor(F.col("_n") * share / 2))
    return pick_some(close.drop("_i", "_n", "_a"), scene, view, f"{seed}-near", n)


def drawn_views(df: DataFrame, scene: str, view: str, share: float, n: int, seed) -> DataFrame:
    """(scene, place, view): a hashed anchor of each scene, then ``n - 1`` hashed draws, with replacement, within ``share`` of its length around it."""
    placed = numbered_by(df.select(scene, view), [view], [scene], "_i")
    anchors = placed.groupBy(scene).agg(F.min_by("_i", F.struct(order_key(seed, scene, view), F.col(view))).alias("_a"), F.count("*").alias("_n"))
    reach = F.floor(F.col("_n") * share / 2)
    low, high = F.greatest(F.col("_a") - reach, F.lit(1)), F.least(F.col("_a") + reach, F.col("_n"))
    places = anchors.select(scene, "_a", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    draw = F.col("_low") + hashed(F.col(scene), F.col("place"), F.lit(seed)) % (F.col("_high") - F.col("_low") + 1)
    wanted = places.select(scene, "place", F.when(F.col("place") == 0, F.col("_a")).otherwise(draw).alias("_i"))
    return wanted.join(placed, [scene, "_i"]).select(scene, "place", view)


def decayed_split(total: Column, key: Column, decay: float) -> Column:
    """A hashed split of a whole number into parts; few parts are likelier the smaller ``decay``."""
    u = hashed(key) / 4294967296.0
    if decay == 1.0:
        parts = F.floor(u * total) + 1
    else:
        parts = F.least(total, F.floor(F.log(1 - u * (1 - F.pow(F.lit(decay), total))) / F.log(F.lit(decay))) + 1)
    ranked = F.slice(F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(total - 1, F.lit(1)).cast("int")), lambda i: F.struct(hashed(key, i).alias("h"), i.alias("i")))), F.lit(1), (parts - 1).cast("int"))
    cuts = F.concat(F.array(F.lit(0)), F.sort_array(F.transform(ranked, lambda s: s["i"])), F.array(total.cast("int")))
    return let(cuts, lambda cuts: F.transform(F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda c, i: c - F.get(cuts, i)))
