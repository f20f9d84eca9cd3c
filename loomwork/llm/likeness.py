"""Pairs of texts whose sets of word shingles have a Jaccard likeness of 0.8 or more: all of them, and no others.

Sets are put in one order, frequent shingles last.  Two sets of that likeness
share a shingle among the first ``n - ceil(0.8 n) + 1`` of each (the prefix
filter), so texts are posted under these only.  Any order is right; rare ones
first keeps the lists short.  Which shingles are frequent is counted in a sample.

Candidates are first held against each other by parity sketches, which can only
rule pairs out that aren't alike, and then verified on the shingles themselves.  A first round offers each
text one partner: of the first text of each list and the one before it by size,
the one that it meets most often.  A second round tallies how often pairs that no
link has joined yet meet in lists, and offers each text the partner that it meets
most often there; a last round offers all pairs that, by the places of their
shared shingles, may be alike.  So families of near copies need few verifications, and
the links give the components that all pairs would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.components import components
from loomwork.llm.shingles import shingle_hashes
from loomwork.llm.storage import forget, keep

WORDS = 5
#: Texts whose shingles are counted, and the most shingles that are told apart as frequent.
SAMPLE_TEXTS = 10_000
FREQUENT = 100_000
#: Members of a list that are paired in one block, and pairs that are tallied before they are summed.
LIST_ROWS = 4_096
TALLY_ROWS = 1_000_000
#: Rows of lists with one least component that go to one task.
HOME_ROWS = 50_000
#: The most parity bits of a sketch, and the bits that say whose texts verification needs (a megabyte).
SKETCH_BITS = 1 << 17
FILTER_BITS = 1 << 23
#: Rounds that offer each text its best partner before all pairs are.
BEST_ROUNDS = 1


def shingle_set(text: bytes) -> np.ndarray:
    """The different shingle hashes of UTF-8 bytes, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def alike(shared, a, b):
    """Whether sets of a and b shingles that share so many have a likeness of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def prefix_size(n: int) -> int:
    """How many of a set's first shingles hold one of any set that is alike."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _sets(texts: DataFrame, run, schema: str) -> DataFrame:
    return texts.select("rep", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), sorted by hash: the shingles that 3 or more of the sampled texts (rep, text) hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t or b"") for t in batch.column(1).to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    every = max(1, texts.count() // SAMPLE_TEXTS)
    some = texts.filter(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0)
    counts = _sets(some, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 3")
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(found: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those not known as frequent by hash, then the others by count."""
    rank = np.zeros(len(found), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        rank = np.where(hashes[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[: prefix_size(len(found))]]


def posted(texts: DataFrame) -> DataFrame:
    """(key, rep, n, at): the texts (rep, text) under their first shingles, in lists of two or more."""
    hashes, counts = frequent_shingles(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t or b"") for t in part.column(1).to_pylist()]
                firsts = [prefix(s, hashes, counts) for s in sets]
                size = [len(f) for f in firsts]
                cols = (
                    np.concatenate(firsts).view(np.int64),
                    np.repeat(part.column(0).to_numpy(zero_copy_only=False), size),
                    np.repeat(np.array([len(s) for s in sets], np.int32), size),
                    np.concatenate([np.arange(n, dtype=np.int32) for n in size]),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "rep", "n", "at"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that have a neighbour of their key; the last row of a batch waits for the next one."""
        before, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy(zero_copy_only=False)
            like = np.r_[before is not None and key[0] == before, key[1:] == key[:-1]]
            mask = like | np.r_[like[1:], False]
            yield batch.slice(0, len(key) - 1).filter(pa.array(mask[:-1]))
            before, held = (key[-2] if len(key) > 1 else before), batch.slice(len(key) - 1)
        if held is not None and before is not None and held.column(0)[0].as_py() == before:
            yield held

    schema = "key bigint, rep bigint, n int, at int"
    rows = _sets(texts, run, schema).repartition("key").sortWithinPartitions("key")
    return keep(rows.mapInArrow(shared, schema), "likeness-lists")


def _possible(x: str, y: str) -> Column:
    """Whether two rows of a list may be alike if the list's shingle is the first that they share."""
    col = lambda side, c: F.col(f"{side}.{c}").cast("bigint")
    left = F.least(col(x, "n") - col(x, "at"), col(y, "n") - col(y, "at"))
    return (F.col(f"{x}.rep") != F.col(f"{y}.rep")) & (9 * left >= 4 * (col(x, "n") + col(y, "n")))


def sketch(found: np.ndarray) -> bytes:
    """A set's parity bits: bit ``h mod size`` is set if an odd number of its hashes fall there; the size is a power of two of twice the set or more."""
    size = 64
    while size < min(2 * len(found), SKETCH_BITS):
        size *= 2
    parity = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, sizes: int) -> bool:
    """Whether sets with these sketches, of so many shingles together, can be alike.

    Sets differ in at least as many shingles as their parity bits differ in, of
    which alike ones have at most a ninth of their sizes; a longer sketch is folded.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= sizes


def sketches(texts: DataFrame) -> DataFrame:
    """(rep, n, bits): each text's number of shingles and sketch, a small part of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t or b"") for t in part.column(1).to_pylist()]
                n = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(map(sketch, sets), pa.binary())], names=["rep", "n", "bits"])

    return keep(_sets(texts, run, "rep bigint, n int, bits binary"), "likeness-sketches")


def _possible_pairs(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))
            yield batch.filter(pa.array([may_be_alike(x, y, n + m) for x, y, n, m in rows], pa.bool_())).select(["a", "b"])

    of = lambda c: prints.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb", "na", "nb")
    return keep(both.mapInArrow(run, "a bigint, b bigint").distinct(), "likeness-possible")  # an id of several texts gives a pair once


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the pairs, and few others: those whose id falls on a marked bit of FILTER_BITS, so that not all texts are dealt out.

    The marks are at most FILTER_BITS / 64 rows, whatever the number of pairs.
    """
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).withColumn("bit", bit)
    marks = ids.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("marks"))
    own = texts.withColumn("_bit", bit)
    near = own.join(F.broadcast(marks), F.floor(F.col("_bit") / 64) == F.col("word"))
    return near.filter("shiftrightunsigned(marks, cast(_bit % 64 as int)) & 1 = 1").select("rep", "text")


def verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (rep, text) that are alike: those that their sketches leave, held against the shingles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            good = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                ta, tb = ta.as_py() or b"", tb.as_py() or b""
                if ta != last[0]:
                    last = (ta, shingle_set(ta))
                a, b = last[1], shingle_set(tb)
                good.append(bool(len(a)) and bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    left = _possible_pairs(pairs, prints)
    some = _texts_of(left, texts)
    of = lambda c: some.select(F.col("rep").alias(c), F.col("text").cast("binary").alias(f"t{c}"))
    both = left.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb")
    found = keep(both.mapInArrow(run, "a bigint, b bigint"), "likeness-links")
    forget(left)
    return found


class _Tally:
    """Pairs of lists that share their least component, with how often they meet."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, rep, n, at, c, own) -> None:
        """The pairs of a list's members that are of different components and may be alike if they share no shingle before
        the list's; if the list is of two blocks, one of each."""
        order = np.argsort(rep, kind="stable")
        rep, n, at, c, own = rep[order], n[order].astype(np.int64), at[order].astype(np.int64), c[order], own[order]
        two = len(own) and own.min() != own.max()
        for start in range(0, len(rep), 512):
            x = slice(start, start + 512)
            fit = (c[x, None] != c[None, start:]) & (rep[x, None] < rep[None, start:])
            left = np.minimum((n - at)[x, None], (n - at)[None, start:])
            fit &= 9 * left >= 4 * (n[x, None] + n[None, start:])
            if two:
                fit &= own[x, None] != own[None, start:]
            i, j = np.nonzero(fit)
            i, j = i + start, j + start
            if len(i):
                self.tables.append(pa.table({"a": rep[i], "b": rep[j], "times": np.ones(len(i), np.int64)}))
                self.rows += len(i)
                if self.rows > TALLY_ROWS:
                    self.tables = [self.summed()]
                    self.rows = len(self.tables[0])

    def summed(self) -> pa.Table:
        found = pa.concat_tables(self.tables).group_by(["a", "b"]).aggregate([("times", "sum")])
        return found.rename_columns(["a", "b", "times"])

    def taken(self, best: bool) -> Iterator[pa.RecordBatch]:
        """All pairs, or of each text only the pair that meets most often."""
        if self.tables:
            found = self.summed()
            if best:
                a, b, times = (found.column(c).to_numpy() for c in ("a", "b", "times"))
                text, row = np.r_[a, b], np.tile(np.arange(len(a)), 2)
                order = np.lexsort((row, -np.tile(times, 2), text))
                first = order[np.r_[True, np.diff(text[order]) != 0]]
                found = found.take(np.unique(row[first]))
            yield from found.cast(_TALLIED).to_batches()
        self.tables, self.rows = [], 0


_TALLIED = pa.schema([(c, pa.int64()) for c in ("a", "b", "times")])


def meeting(lists: DataFrame, most: int = LIST_ROWS, best: bool = False) -> DataFrame:
    """(a, b): pairs of different components that may be alike by the ``lists`` (key, rep, n, at, c) in which they meet.

    Lists with the same least component mostly have the same members, as copies
    share runs of shingles; they go to one task, or to one for each HOME_ROWS rows,
    which tallies a pair once for all of them.  Lists of over ``most`` members are
    cut in blocks, and each two blocks are a list of their own.  With ``best`` a
    text gives one pair for each share of lists that it is in, the one that meets
    most often there.
    """
    mixed = lists.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).filter("lo < hi")
    shares = mixed.groupBy("lo").agg(F.ceil(F.sum("m") / HOME_ROWS).cast("int").alias("shares"))
    share = F.xxhash64("lo", F.pmod(F.xxhash64("key"), "shares"))
    mixed = mixed.join(shares, "lo").select("key", share.alias("home"), F.ceil(F.col("m") / most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep", "key"), "blocks").cast("int")
    of_two = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = lists.join(mixed, "key").withColumn("own", own).withColumn("part", F.explode(of_two))
    home = F.when(F.col("blocks") > 1, F.xxhash64("key", "part.i", "part.j")).otherwise(F.col("home"))
    rows = dealt.select(home.alias("home"), F.xxhash64("key", "part.i", "part.j").alias("list"), "rep", "n", "at", "c", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, held, last_home = _Tally(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(both) for both in zip(held, cols)]
            edge = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            starts = np.r_[0, edge]
            for s, e in zip(starts[:-1].tolist(), edge.tolist()):
                if cols[0][s] != last_home:
                    yield from tally.taken(best)
                    last_home = cols[0][s]
                tally.add(*(c[s:e] for c in cols[2:]))
            held = [c[starts[-1] :] for c in cols]
        if held is not None:
            if held[0][0] != last_home:
                yield from tally.taken(best)
            tally.add(*held[2:])
        yield from tally.taken(best)

    schema = "a bigint, b bigint, times bigint"
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work: not to be coalesced
    found = rows.repartition(tasks, "home").sortWithinPartitions("home", "list").mapInArrow(run, schema)
    if best:
        sums = found.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
        turned = found.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
        return sums.select("a", "b").unionByName(turned.select("a", "b")).distinct()
    return found.select("a", "b").distinct()


def links(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links between texts (rep, text) that, with the ``known`` ones, join what all pairs that are alike join."""
    lists, prints = posted(texts), sketches(texts)
    row = F.struct("n", "rep", "at")
    w = Window.partitionBy("key").orderBy("n", "rep")
    beside = lists.select(row.alias("y"), F.array(F.first(row).over(w), F.lag(row).over(w)).alias("x"))
    near = beside.select("y", F.explode(F.array_distinct("x")).alias("x")).filter(_possible("x", "y"))
    near = near.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.count("*").alias("times"))
    best = near.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
    offered = keep(best.select("a", "b"), "likeness-pairs")
    found = [verified(offered, texts, prints)]
    forget(offered)

    def named() -> DataFrame:
        labels = components(reduce(DataFrame.unionByName, found, known.select("a", "b"))).withColumnRenamed("node", "rep")
        return lists.join(labels, "rep", "left").select("key", "rep", "n", "at", F.coalesce("component", "rep").alias("c"))

    # each text's best partner in another component; then all pairs that are left
    for last in (*[False] * BEST_ROUNDS, True):
        rest = keep(meeting(named(), best=not last), "likeness-pairs")
        found.append(verified(rest, texts, prints))
        forget(rest)
    forget(lists, prints)
    return reduce(DataFrame.unionByName, found)
