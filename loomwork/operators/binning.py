"""Greedy token-budget packing: an ordered fold per shard, as a batch operator or over a stream's state."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    """``most`` tokens of a bin, ``expected`` tokens that close it, ``per_sample`` tokens of one sample.

    ``buffer`` samples that didn't fit wait first-in first-out and go first while
    the bin holds under ``prefer_below`` tokens.  ``carry`` keeps the sample that
    closes a bin for the next one; without it that sample is dropped.
    """

    most: int
    expected: int
    per_sample: int
    buffer: int = 0
    prefer_below: int = 0
    carry: bool = False


@dataclass
class Packer:
    """The fold of one shard: offer samples in order; it tells where each goes.

    A bin begins with one sample of every mandatory group, if such groups are
    given; they must be under ``per_sample``, other samples may reach it.
    """

    budget: Budget
    mandatory: tuple[str, ...] = ()
    bin: int = 0
    curr: int = 0
    pos: int = 0
    held: deque = field(default_factory=deque)
    waiting: dict = field(default_factory=dict)
    queue: Callable[[str], deque] = lambda name: deque()  # noqa: E731  of a group's name; '' is all other samples

    def __post_init__(self) -> None:
        self.plain = self.queue("")
        self.waiting = {g: self.queue(g) for g in self.mandatory}

    def _place(self, key, n: int) -> tuple:
        row = (key, "packed", self.bin, self.pos, self.curr, n)
        self.curr += n
        self.pos += 1
        return row

    def _close(self) -> None:
        if self.pos:
            self.bin += 1
        self.curr = self.pos = 0

    def _try(self, key, n: int, buffered: bool) -> Iterator[tuple]:
        b = self.budget
        if n > b.per_sample:
            yield (key, "too_long", None, None, None, n)
        elif self.curr + n > b.most:
            if b.buffer and len(self.held) < b.buffer and not buffered:
                self.held.append((key, n))
                return
            self._close()
            if b.carry and n <= b.most:
                yield self._place(key, n)
                if self.curr >= b.expected:
                    self._close()
            else:
                yield (key, "dropped", None, None, None, n)
        else:
            yield self._place(key, n)
            if self.curr >= b.expected:
                self._close()

    def offer(self, key, n: int, group: str | None = None) -> Iterator[tuple]:
        """(key, state, bin, pos, start, n) for each sample whose place is known now."""
        if self.mandatory:
            if group in self.mandatory:
                if n >= self.budget.per_sample:
                    yield (key, "too_long", None, None, None, n)
                else:
                    self.waiting[group].append((key, n))
            else:
                self.plain.append((key, n))
            while self.plain:
                if self.curr == 0 and self.pos == 0:
                    if not all(self.waiting[g] for g in self.mandatory):
                        return
                    for g in self.mandatory:
                        yield self._place(*self.waiting[g].popleft())
                yield from self._try(*self.plain.popleft(), buffered=False)
            return
        while self.held and self.curr < self.budget.prefer_below:
            yield from self._try(*self.held.popleft(), buffered=True)
        yield from self._try(key, n, buffered=False)

    def rest(self) -> Iterator[tuple]:
        """Samples that still wait when the shard ends."""
        for key, n in self.held:
            yield (key, "waiting", None, None, None, n)
        for queue in [*self.waiting.values(), self.plain]:
            for key, n in queue:
                yield (key, "waiting", None, None, None, n)


PLACES = "shard int, id bigint, state string, bin bigint, pos bigint, start bigint, tokens bigint"


def packed(samples: DataFrame, budget: Budget, mandatory: tuple[str, ...] = ()) -> DataFrame:
    """Places of samples (shard, rn, id, tokens[, grp]) in their shard's bins, in order of rn.

    Shards are sorted and streamed through the fold, so a task holds one bin's
    counters (and the buffer), whatever its shards' size.  Parallelism is the
    number of shards, which is part of the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, shard = None, object()
        for batch in batches:
            rows = []
            groups = batch.column(3).to_pylist()
            for s, key, n, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), groups):
                if s != shard:
                    if packer is not None:
                        rows += [(shard, *r) for r in packer.rest()]
                    packer, shard = Packer(budget, mandatory), s
                rows += [(s, *r) for r in packer.offer(key, n, g)]
            yield _batch(rows)
        if packer is not None:
            yield _batch([(shard, *r) for r in packer.rest()])

    group = F.col("grp") if "grp" in samples.columns else F.lit(None).cast("string")
    ordered = samples.repartition("shard").sortWithinPartitions("shard", "rn")
    return ordered.select("shard", F.col("id").cast("bigint"), F.col("tokens").cast("bigint"), group.alias("grp")).mapInArrow(run, PLACES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["shard", "id", "state", "bin", "pos", "start", "tokens"]
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def with_offsets(df: DataFrame, group: list[str], order: str, length: str) -> DataFrame:
    """Running start and end of each row in its group."""
    end = F.sum(length).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(length))


def padding_rows(places: DataFrame, most: int) -> DataFrame:
    """One padding segment for each bin that isn't full: it starts where the bin's tokens end."""
    sums = places.filter("state = 'packed'").groupBy("shard", "bin").agg(F.sum("tokens").alias("start"), F.count("*").alias("pos"))
    return sums.filter(F.col("start") < most).withColumn("tokens", F.lit(most) - F.col("start"))
