"""Endless epochs over row groups as a streaming source: every epoch is a shuffle of its own.

The offset is (epoch, position), position counting row groups in the epoch's
order.  An epoch orders the groups by md5 of ``file:row_group:seed:epoch`` and
the rows inside a group by md5 of ``key:seed:epoch``.  A task reads a run of
groups one after another, so it holds one group, and nothing but the small plan
is held by the driver.  A trigger takes
``groups_per_trigger`` groups; the last offset that was offered stands in a
cursor file, and the query's checkpoint says what was taken, so a restart goes
on in the middle of an epoch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomwork.sources.shared import scratch, store

FORMAT = "epochs"
PLACE = "epoch bigint, global_row_group bigint, pos int"


@dataclass
class EpochGroup:
    epoch: int
    ordinal: int
    path: str
    row_group: int


@dataclass
class EpochRun(InputPartition):
    groups: list[EpochGroup]


class EpochReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)
        self.plan, self._groups = options["plan"], None
        self.seed, self.key, self.cursor = options["seed"], options["key"], options["cursor"]
        self.step = int(options.get("groups_per_trigger", "8"))
        self.tasks = int(options.get("tasks", "8"))
        self.epochs = int(options["epochs"]) if options.get("epochs") else None
        self._orders: dict = {}

    @property
    def groups(self) -> list[tuple[str, int]]:
        """Read when offsets are planned; a task that reads a group doesn't need them."""
        if self._groups is None:
            where, name = store(self.plan)
            with where.open_input_stream(name) as f:
                self._groups = [tuple(g) for g in json.loads(f.read())]
        return self._groups

    def _order(self, epoch: int) -> list[tuple[str, int]]:
        if epoch not in self._orders:
            mark = lambda g: hashlib.md5(f"{g[0].rsplit('/', 1)[-1]}:{g[1]}:{self.seed}:{epoch}".encode()).hexdigest()
            self._orders = {epoch: sorted(self.groups, key=lambda g: (mark(g), g))}
        return self._orders[epoch]

    def initialOffset(self) -> dict:
        return {"epoch": 0, "position": 0}

    def latestOffset(self) -> dict:
        """The offered offset, moved on by a trigger's groups; it stays at the end of the last epoch, if there is one."""
        where, name = store(self.cursor)
        try:
            with where.open_input_stream(name) as f:
                now = json.loads(f.read())
        except FileNotFoundError:
            now = self.initialOffset()
        at = self._flat(now) + self.step
        if self.epochs is not None:
            at = min(at, self.epochs * len(self.groups))
        n = max(len(self.groups), 1)
        then = {"epoch": at // n, "position": at % n}
        if then != now:
            where.create_dir(name.rpartition("/")[0], recursive=True)
            with where.open_output_stream(f"{name}.next") as f:
                f.write(json.dumps(then).encode())
            where.move(f"{name}.next", name)
        return then

    def _flat(self, offset: dict) -> int:
        return offset["epoch"] * len(self.groups) + offset["position"]

    def partitions(self, start: dict, end: dict) -> list[EpochRun]:
        n = len(self.groups)
        groups = [EpochGroup(at // n, at % n, *self._order(at // n)[at % n]) for at in range(self._flat(start), self._flat(end))]
        tasks = min(self.tasks, len(groups))
        return [EpochRun(groups[len(groups) * i // tasks : len(groups) * (i + 1) // tasks]) for i in range(tasks)]

    def read(self, partition: EpochRun) -> Iterator[pa.RecordBatch]:
        for group in partition.groups:
            yield from self._read(group)

    def _read(self, partition: EpochGroup) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        where, name = store(partition.path)
        own = [n for n in self.arrow.names if n not in _PLACE_NAMES]
        with where.open_input_file(name) as f:
            rows = pq.ParquetFile(f).read_row_group(partition.row_group, columns=sorted({*own, self.key}))
        keys = [hashlib.md5(f"{k}:{self.seed}:{partition.epoch}".encode()).hexdigest() for k in rows.column(self.key).to_pylist()]
        rows = rows.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64()))
        n = rows.num_rows
        more = {"epoch": [partition.epoch] * n, "global_row_group": [partition.ordinal] * n, "pos": range(n)}
        columns = [pa.chunked_array([pa.array(more[f.name], f.type)]) if f.name in more else rows.column(f.name).cast(f.type) for f in self.arrow]
        yield from pa.table(columns, schema=self.arrow).to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        pass


_PLACE_NAMES = {f.split()[0] for f in PLACE.split(", ")}


class Epochs(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def streamReader(self, schema):
        return EpochReader(schema, dict(self.options))


def epochs(spark: SparkSession, manifest: DataFrame, columns: T.StructType | str, key: str, cursor: str, seed=0, groups_per_trigger: int = 8, last: int | None = None) -> DataFrame:
    """A stream of the columns and (epoch, global_row_group, pos) over the manifest's row groups; endless without ``last`` epochs."""
    spark.dataSource.register(Epochs)
    own = T._parse_datatype_string(columns) if isinstance(columns, str) else columns
    schema = T.StructType([*own.fields, *T._parse_datatype_string(PLACE).fields])
    groups = [(r["path"], i) for r in manifest.select("path", "num_row_groups").orderBy("path").collect() for i in range(r["num_row_groups"])]
    plan = f"{scratch(spark, 'epochs')}.json"
    where, name = store(plan)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as f:
        f.write(json.dumps(groups).encode())
    options = {"plan": plan, "seed": str(seed), "key": key, "cursor": cursor, "groups_per_trigger": str(groups_per_trigger), "tasks": str(3 * spark.sparkContext.defaultParallelism)}
    if last is not None:
        options["epochs"] = str(last)
    return spark.readStream.format(FORMAT).schema(schema).options(**options).load()


def run_epochs(stream: DataFrame, path: str, checkpoint: str, rows: int, triggers: int = 10_000) -> int:
    """Takes trigger after trigger, each as a run of its own that resumes the last, until the table has so many rows; returns the runs."""
    spark = stream.sparkSession
    for done in range(triggers):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if spark.read.schema(stream.schema).parquet(path).count() >= rows:
            return done + 1
    return triggers
