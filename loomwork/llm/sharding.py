"""Sharding by balanced label propagation: linked documents meet in a shard while every shard gets as many rows as the others.

The law is ``rows``: shard sizes differ by one row at most.  Documents of one
group (equal texts, or any given group key) are linked to each other.  Every
document starts with a label from its id.  In each round the documents of a
group move together towards the label that most of them have, among the shards
that still have room for them; a shard admits the movers in order of size while
its quota lasts, and those turned away look again, with the rooms that are left,
in the next round.  Groups that fit nowhere whole, and documents without links,
then fill the rooms.

Documents of a group are interchangeable, so the rounds work on one row per
group that holds its members' labels (at most one entry a shard): no pairs and
no document rows meet.  Groups larger than a shard are under one per shard; they
are laid over as few shards as can hold them before the rounds.  Running sums
are two sums: over ranges, which are bounded in number, and inside a range.
Every round is written to the shared folder.

A null text has no bytes and counts as empty; a null doc_id is an id like any
other; repeated rows are rows of their own, linked to each other.  Columns beside
doc_id and text aren't read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.storage import forget, keep

SHARDS = 24
#: Bytes of a document beside its text.
OVERHEAD = 8
MAX_ROUNDS = 16
#: Ranges that running sums are cut into, for each shard and size class.
SLOTS = 256
#: Ranges that a group's rows, or a shard's, are numbered in.
SPOTS = 4096


def nodes(documents: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, grp, spot): what sharding needs of a document; ``grp`` is equal for equal texts."""
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(SPOTS)).cast("int")
    return documents.select(
        "doc_id",
        (F.octet_length(bytes_) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.unhex(F.md5(bytes_)).alias("grp"),
        spot.alias("spot"),
    )


def _running(df: DataFrame, keys: list[str], ranges: list[str], order: list, amount: str) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows before, within ``keys`` (null-safe) and in order of ``ranges`` and ``order``."""
    own = [*keys, *ranges]
    sums = df.groupBy(*own).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in own], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    local = df.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(starts, same).withColumn("before", F.col("_start") + F.col("_local")).drop("_start", "_local", *[f"_{c}" for c in own])


def _pieces(at: Column, rooms: list[tuple[int, int]]) -> Column:
    """The shard of a position on a line made of (shard, length) pieces laid end to end."""
    found, end = F.lit(None).cast("int"), 0
    ends = []
    for shard, length in rooms:
        end += length
        ends.append((shard, end))
    for shard, end in reversed(ends):
        found = F.when(at < end, F.lit(shard)).otherwise(found)
    return found


def _cut(pieces: list[list[int]], need: int) -> list[tuple[int, int]]:
    """Takes ``need`` rows off the front of (shard, length) pieces, which shrink."""
    taken = []
    while need:
        shard, length = pieces[0]
        n = min(need, length)
        taken.append((shard, n))
        need -= n
        pieces[0][1] -= n
        if not pieces[0][1]:
            pieces.pop(0)
    return taken


def _round(pending: DataFrame, rooms: list[int]) -> DataFrame:
    """The groups with the shard that they move to, and whether it has admitted them.

    The wanted shard is the commonest label of the group's documents among the
    shards with room for all of them; without such a label any shard with room,
    by hash.
    """
    room = F.array(*[F.lit(r).cast("bigint") for r in rooms])
    open_ = lambda s: F.get(room, s) >= F.col("total")
    mixed = lambda s: F.pmod(F.xxhash64("grp", s), F.lit(1 << 30))
    voted = F.transform(
        F.filter("labels", lambda x: open_(x["shard"])), lambda x: F.struct(x["n"].alias("n"), mixed(x["shard"]).alias("tie"), x["shard"].alias("shard"))
    )
    spare = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(len(rooms) - 1)), open_), lambda s: F.struct(F.lit(0).cast("bigint").alias("n"), mixed(s).alias("tie"), s.alias("shard"))
    )
    wanted = F.coalesce(F.array_max(voted), F.array_max(spare))["shard"]
    movers = pending.withColumn("shard", wanted).filter("shard is not null")
    movers = movers.withColumn("rank", (-F.floor(F.log2(F.col("total").cast("double")))).cast("int")).withColumn("slot", F.pmod(F.hash("grp"), F.lit(SLOTS)))
    queued = _running(movers, ["shard"], ["rank", "slot"], [F.desc("total"), "grp"], "total")
    fits = F.col("before") + F.col("total") <= F.get(room, F.col("shard"))
    return queued.select("grp", "total", "labels", "shard", fits.alias("admitted"))


def balanced(rows: DataFrame, shards: int = SHARDS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Adds ``shard`` to rows of (doc_id, grp, spot): rows per shard at most one apart, groups in as few shards as found.

    ``spot`` is a uniform number under ``SPOTS`` that spreads a group's rows.
    After ``max_rounds`` rounds, or when nothing moves any more, what waits is
    laid over the rooms that are left, cut where a room ends.
    """
    labels = rows.groupBy("grp", F.pmod("spot", F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    groups = labels.groupBy("grp").agg(F.sum("n").alias("total"), F.collect_list(F.struct("shard", "n")).alias("labels"))
    groups = keep(groups, "shard-groups")
    count = groups.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    quota = [count // shards + (s < count % shards) for s in range(shards)]
    linked = groups.filter("total > 1")
    # of groups larger than count / shards there are fewer than shards
    giants = [(r["grp"], r["total"]) for r in linked.filter(F.col("total") > quota[-1]).select("grp", "total").orderBy(F.desc("total"), "grp").collect()]
    pieces = [[s, n] for s, n in enumerate(quota) if n]
    lines = [(bytes(g), _cut(pieces, n)) for g, n in giants]
    rooms = [0] * shards
    for s, n in pieces:
        rooms[s] += n
    pending, settled, used = linked.filter(F.col("total") <= quota[-1]), [], [groups]
    for _ in range(max_rounds):
        step = keep(_round(pending, rooms), "shard-round")
        used.append(step)
        taken = {r["shard"]: r["n"] for r in step.filter("admitted").groupBy("shard").agg(F.sum("total").alias("n")).collect()}  # a row a shard
        if not taken:
            break
        rooms = [r - taken.get(s, 0) for s, r in enumerate(rooms)]
        settled.append(step.filter("admitted").select("grp", "shard"))
        waits = pending.join(step.filter("admitted").select("grp"), "grp", "left_anti")
        pending = keep(waits, "shard-waiting")
        used.append(pending)
    left = keep(_running(pending.select("grp", "total", (-F.col("total")).alias("rank"), F.pmod(F.hash("grp"), F.lit(SLOTS)).alias("slot"), F.lit(0).alias("all")), ["all"], ["slot"], ["rank", "grp"], "total"), "shard-left")
    used.append(left)
    n_left = left.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    schema = "grp binary, shard int, start bigint"
    places = rows.sparkSession.createDataFrame([], schema)
    for part in settled:
        places = places.unionByName(part.select("grp", "shard", F.lit(None).cast("bigint").alias("start")))
    places = places.unionByName(left.select("grp", F.lit(None).cast("int").alias("shard"), F.col("before").alias("start")))

    is_giant = F.col("grp").isin([g for g, _ in lines]) if lines else F.lit(False)
    rest = rows.filter(~is_giant).join(places, "grp", "left")
    whole = rest.filter("shard is not null").drop("start")
    # the others take positions: in their giant, in the line of groups that wait, or behind it
    own = F.when(is_giant | F.col("start").isNotNull(), F.col("grp"))
    loose = rest.filter("shard is null").drop("shard").unionByName(rows.filter(is_giant).withColumn("start", F.lit(None).cast("bigint")))
    loose = loose.withColumn("line", own).withColumn("one", F.lit(1))
    placed = _running(loose, ["line"], ["spot"], ["doc_id"], "one")
    at = F.when(F.col("line").isNull(), F.col("before") + n_left).otherwise(F.col("before") + F.coalesce("start", F.lit(0)))
    shard = _pieces(at, [(s, r) for s, r in enumerate(rooms) if r])
    for grp, line in lines:
        shard = F.when(F.col("line") == F.lit(grp), _pieces(F.col("before"), line)).otherwise(shard)
    out = placed.withColumn("shard", shard).select(*rows.columns, "shard")
    result = keep(whole.select(*rows.columns, "shard").unionByName(out), "shards")
    forget(*used)
    return result


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 inside each shard, in order of (spot, doc_id)."""
    return _running(rows.withColumn("one", F.lit(1)), ["shard"], ["spot"], ["doc_id"], "one").withColumnRenamed("before", "slot").drop("one")


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    rows = keep(nodes(documents), "shard-nodes")
    out = keep(with_slots(balanced(rows, shards)), "sharded")
    forget(rows)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
