"""Greedy packing over a stream: a shard's open bin and waiting samples are state, kept by Spark's state store on disk.

The fold is :class:`loomwork.operators.binning.Packer`.  Its counters and the
bounded overflow buffer are one value; samples that wait for a mandatory group
stand in a map from running numbers, an entry a run of samples, so that a group that
comes rarely fills the state store and not a task's memory.  What still waits is
given out when a shard's end mark comes (a row whose ``last`` is true), or, with
``linger``, when no sample has come for so many milliseconds; a query with timers
never runs out of batches, so it needs a processing-time trigger.

Within a trigger samples are offered in order of ``rn``, so triggers must come in
that order.  The state store must be RocksDB's; :func:`with_state_store` sets it.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomwork.operators.binning import PLACES, Budget, Packer

SAMPLES = "shard int, rn bigint, id bigint, tokens bigint, grp string, last boolean"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def with_state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)


#: Samples of a queue that share an entry of the state, and that the task holds at either end.
CHUNK = 1024


class StateQueue:
    """A first-in first-out queue in map state, an entry up to ``CHUNK`` samples.

    The counters keep (first entry, entry behind the last, samples).  The task
    holds what it read of the first entry and what isn't written yet;
    :meth:`flush` writes both back.
    """

    def __init__(self, name: str, state, ends: dict):
        self.name, self.state, self.front, self.fresh = name, state, deque(), deque()
        self.ends = ends.setdefault(name, [0, 0, 0])

    def __len__(self) -> int:
        return self.ends[2]

    def append(self, item: tuple[int, int]) -> None:
        self.fresh.append(item)
        self.ends[2] += 1
        if len(self.fresh) >= CHUNK:
            self._write_fresh()

    def popleft(self) -> tuple[int, int]:
        if not self.front and self.ends[0] < self.ends[1]:
            key = (self.name, self.ends[0])
            self.front.extend(map(tuple, json.loads(self.state.getValue(key)[0])))
            self.state.removeKey(key)
            self.ends[0] += 1
        self.ends[2] -= 1
        return (self.front or self.fresh).popleft()

    def _write_fresh(self) -> None:
        self.state.updateValue((self.name, self.ends[1]), (json.dumps(list(self.fresh)),))
        self.ends[1] += 1
        self.fresh.clear()

    def flush(self) -> None:
        if self.front:
            self.ends[0] -= 1
            self.state.updateValue((self.name, self.ends[0]), (json.dumps(list(self.front)),))
            self.front.clear()
        if self.fresh:
            self._write_fresh()

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while self:
            yield self.popleft()


class PackingProcessor(StatefulProcessor):
    def __init__(self, budget: Budget, mandatory: tuple[str, ...] = (), linger: int | None = None):
        self.budget, self.mandatory, self.linger = asdict(budget), mandatory, linger

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "text string")
        self.queued = handle.getMapState("queued", "queue string, number bigint", "samples string")

    def _packer(self) -> tuple[Packer, dict]:
        was = json.loads(self.counters.get()[0]) if self.counters.exists() else {}
        ends = was.get("ends", {})
        packer = Packer(Budget(**self.budget), self.mandatory, queue=lambda name: StateQueue(name, self.queued, ends))
        packer.bin, packer.curr, packer.pos = was.get("at", (0, 0, 0))
        packer.held = deque(map(tuple, was.get("held", [])))
        return packer, ends

    def _keep(self, packer: Packer, ends: dict) -> None:
        for queue in [packer.plain, *packer.waiting.values()]:
            queue.flush()
        self.counters.update((json.dumps({"at": [packer.bin, packer.curr, packer.pos], "held": list(packer.held), "ends": ends}),))

    def _given_out(self, packer: Packer) -> list[tuple]:
        """Everything that waits; the packer has nothing left to give."""
        rows = list(packer.rest())
        packer.held.clear()
        return rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packer, ends = self._packer()
        samples = pd.concat(list(rows)).sort_values("rn", na_position="last")
        out = []
        for i, n, group, last in zip(samples["id"], samples["tokens"], samples["grp"], samples["last"]):
            if last is True or last == 1:
                out += self._given_out(packer)
            else:
                out += packer.offer(int(i), int(n), group)
        self._keep(packer, ends)
        if self.linger is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.linger)
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        packer, ends = self._packer()
        out = self._given_out(packer)
        self._keep(packer, ends)
        yield self._frame(key[0], out)

    def _frame(self, shard: int, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(shard, *r) for r in rows], columns=[c.split()[0] for c in PLACES.split(", ")])
        return frame.astype({"shard": "int32", "id": "Int64", "bin": "Int64", "pos": "Int64", "start": "Int64", "tokens": "Int64"})

    def close(self) -> None:
        pass


def packed(samples: DataFrame, budget: Budget, mandatory: tuple[str, ...] = (), linger: int | None = None) -> DataFrame:
    """Places of a stream of (shard, rn, id, tokens[, grp][, last]), as the batch operator gives them."""
    more = {}
    if "grp" not in samples.columns:
        more["grp"] = F.lit(None).cast("string")
    if "last" not in samples.columns:
        more["last"] = F.lit(False)
    named = samples.withColumns(more) if more else samples
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in SAMPLES.split(", ")]
    return named.select(*columns).groupBy("shard").transformWithStateInPandas(
        PackingProcessor(budget, mandatory, linger), PLACES, "append", "none" if linger is None else "processingTime"
    )
