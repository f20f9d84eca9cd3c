"""Parquet by row groups: exact files, footers read by executors, and a data source whose unit is a row group.

Files are named ``prefix_00000.parquet`` and hold an exact number of rows in
groups of an exact number of rows, in a seeded order; each write adds a part to
the folder's manifest, and a later write goes on behind it.  A plan is the order
of the row groups (by path, or by a seeded shuffle), cut to one rank, to what
lies behind a cursor or to the groups that hold the first n rows; Spark then
opens no other group.  Footers and groups are read through Arrow's file systems.

A file that the manifest doesn't know isn't read and is told by
:func:`not_in_manifest`; a file that can't be opened is told in ``error`` by
:func:`footers`, and skipped (or raised) by the scan.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomwork.operators.ordering import numbered, order_key
from loomwork.sources.shared import scratch, store, url

FORMAT = "rowgroups"
MANIFEST = "_manifest"
#: Partitions of a scan for each core.
TASKS = 4
#: What the scan adds to a file's own columns.
PLACE = "file string, row_group int, row_idx bigint, global_row_group bigint"
FOOTERS = "path string, row_group int, first_row bigint, num_rows bigint, bytes bigint, error string"


# --- footers and manifests


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path): the Parquet files under a path; nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"))


def footers(files: DataFrame, tasks: int = 64) -> DataFrame:
    """A row per row group of the files (path), from footers that executors read; ``first_row`` counts in the file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        kind = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("first_row", pa.int64()), ("num_rows", pa.int64()), ("bytes", pa.int64()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    where, name = store(path)
                    with where.open_input_file(name) as f:
                        meta = pq.read_metadata(f)
                except (OSError, pa.ArrowException) as e:
                    rows.append((path, None, None, None, None, type(e).__name__))
                    continue
                first = 0
                for i in range(meta.num_row_groups):
                    group = meta.row_group(i)
                    rows.append((path, i, first, group.num_rows, group.total_byte_size, None))
                    first += group.num_rows
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)

    return files.select("path").repartition(tasks).mapInArrow(read, FOOTERS)


def manifest_of(groups: DataFrame) -> DataFrame:
    """(path, num_row_groups, num_rows) of readable files."""
    good = groups.filter("error is null")
    return good.groupBy("path").agg(F.count("*").cast("int").alias("num_row_groups"), F.sum("num_rows").alias("num_rows"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object ``{path: {num_row_groups, num_rows}}`` a file."""
    entry = F.create_map("path", F.struct("num_row_groups", "num_rows"))
    manifest.select(F.to_json(entry).alias("value")).write.mode("append").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, num_row_groups, num_rows) of manifest files that hold one object or several, in one line or many."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    listed = F.concat(F.lit("["), F.regexp_replace("value", r"\}\s*\}\s*\{", "}},{"), F.lit("]"))
    parsed = F.from_json(listed, "array<map<string,struct<num_row_groups:int,num_rows:bigint>>>")
    return text.select(F.explode(parsed).alias("m")).select(F.explode("m").alias("path", "v")).select("path", "v.*")


def not_in_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.select("path").join(manifest.select("path"), "path", "left_anti")


# --- exact files


@dataclass
class Files(WriterCommitMessage):
    written: list = field(default_factory=list)


class ExactWriter(DataSourceArrowWriter):
    """Rolls a file when the first column, its number, changes; the column isn't written."""

    def __init__(self, path: str, prefix: str, rows_per_group: int):
        self.path, self.prefix, self.rows_per_group = path, prefix, rows_per_group

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        where, base = store(self.path)
        where.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done, number, writer, held = [], None, None, []

        def flush(all_rows: bool) -> None:
            """Writes full groups of what is held, and with ``all_rows`` the rest."""
            table = pa.Table.from_batches(held)
            at = 0
            while table.num_rows - at >= self.rows_per_group or (all_rows and at < table.num_rows):
                writer.write_table(table.slice(at, self.rows_per_group), row_group_size=self.rows_per_group)
                done[-1]["num_row_groups"] += 1
                at += self.rows_per_group
            held[:] = [] if at >= table.num_rows else table.slice(at).to_batches()

        def close() -> None:
            if writer is not None:
                if held:
                    flush(True)
                writer.close()

        for batch in iterator:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            rows = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if int(numbers[a]) != number:
                    close()
                    number = int(numbers[a])
                    name = f"{self.prefix}_{number:05d}.parquet"
                    done.append({"tmp": f"{base}/.{name}.{attempt}", "name": name, "num_row_groups": 0, "num_rows": 0})
                    writer = pq.ParquetWriter(done[-1]["tmp"], rows.schema, filesystem=where)
                held.append(rows.slice(a, b - a))
                done[-1]["num_rows"] += b - a
                if sum(x.num_rows for x in held) >= self.rows_per_group:
                    flush(False)
        close()
        return Files(done)

    def commit(self, messages) -> None:
        """Names the files, then writes the manifest part that makes them known."""
        where, base = store(self.path)
        files = sorted((f for m in messages if m for f in m.written), key=lambda f: f["name"])
        for f in files:
            where.move(f["tmp"], f"{base}/{f['name']}")
        if files:
            where.create_dir(f"{base}/{MANIFEST}", recursive=True)
            text = json.dumps({f"{url(self.path).rstrip('/')}/{f['name']}": {k: f[k] for k in ("num_row_groups", "num_rows")} for f in files})
            with where.open_output_stream(f"{base}/{MANIFEST}/part-{uuid.uuid4().hex}.json") as out:
                out.write(text.encode())

    def abort(self, messages) -> None:
        where, _ = store(self.path)
        for message in messages:
            for f in message.written if message else []:
                where.delete_file(f["tmp"])


def write_exact(df: DataFrame, path: str, prefix: str, keys: list[str], seed=0, rows_per_file: int = 5000, rows_per_group: int = 500) -> int:
    """Writes rows in a seeded order of their keys; returns the number of the first file.

    Every file but the last has ``rows_per_file`` rows, and a file is one task's
    work.  Files that the folder's manifest knows stay; numbers go on behind them.
    """
    register(df.sparkSession)
    first = next_number(df.sparkSession, path, prefix)
    placed = numbered(df.withColumn("_k", order_key(seed, *keys)), "_k", keys, number="_rn")
    number = (F.floor((F.col("_rn") - 1) / rows_per_file) + first).cast("bigint")
    rows = placed.withColumn("_file", number).repartition("_file").sortWithinPartitions("_file", "_rn").select("_file", *df.columns)
    options = {"path": path, "prefix": prefix, "rows_per_group": str(rows_per_group)}
    rows.write.format(FORMAT).options(**options).mode("append").save()
    return first


def next_number(spark: SparkSession, path: str, prefix: str) -> int:
    known = existing_manifest(spark, path)
    if known is None:
        return 0
    number = F.regexp_extract("path", rf"{prefix}_(\d+)\.parquet$", 1)
    return known.agg(F.coalesce(F.max(F.nullif(number, F.lit("")).cast("bigint")) + 1, F.lit(0))).first()[0]


def existing_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    from pyarrow import fs

    where, base = store(f"{path.rstrip('/')}/{MANIFEST}")
    if where.get_file_info(base).type == fs.FileType.NotFound:
        return None
    return read_manifest(spark, f"{path.rstrip('/')}/{MANIFEST}")


def resume_exact(df: DataFrame, path: str, prefix: str, keys: list[str], **layout) -> int:
    """Writes the rows whose keys the folder's known files don't hold yet."""
    spark = df.sparkSession
    known = existing_manifest(spark, path)
    if known is None:
        return write_exact(df, path, prefix, keys, **layout)
    done = scan(spark, path, df.select(*keys).schema, manifest=known).select(*keys)
    return write_exact(df.join(done, keys, "left_anti").select(*df.columns), path, prefix, keys, **layout)


# --- the scan


@dataclass
class Group(InputPartition):
    ordinal: int
    path: str
    row_group: int
    skip: int = 0
    take: int = -1


def plan(
    manifest: list[tuple[str, int, int]],
    seed: int | None = None,
    rank: int = 0,
    world: int = 1,
    after: tuple[str, int, int] | None = None,
) -> list[Group]:
    """The row groups (path, row_group) of a manifest in order: by path, or by a seeded shuffle of file names and groups.

    A rank has one of ``world`` runs of groups, whose sizes differ by one at
    most; ``after`` is the (path, row_group, row_idx) that was read last.  The
    driver holds a small entry a group, as it does for Spark's own splits.
    """
    groups = sorted((path, g) for path, count, _ in manifest for g in range(count))
    if seed is not None:
        groups.sort(key=lambda p: (hashlib.md5(f"{p[0].rsplit('/', 1)[-1]}:{p[1]}:{seed}".encode()).hexdigest(), p))
    a, b = len(groups) * rank // world, len(groups) * (rank + 1) // world
    mine = [Group(i, path, g) for i, (path, g) in enumerate(groups[a:b])]
    if after is None:
        return mine
    at = next((x.ordinal for x in mine if (x.path, x.row_group) == (url(after[0]), after[1])), None)
    if at is None:
        raise ValueError(f"the plan has no group {after[:2]}")
    rest = mine[at:]
    rest[0].skip = after[2] + 1
    return rest


@dataclass
class Run(InputPartition):
    """Groups that one task reads, in order."""

    groups: list


def runs(groups: list[Group], tasks: int) -> list[Run]:
    """The groups in ``tasks`` runs at most, whose sizes differ by one at most; their number doesn't grow with the table."""
    n = max(1, min(tasks, len(groups)))
    return [Run(groups[len(groups) * i // n : len(groups) * (i + 1) // n]) for i in range(n)]


class GroupReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)
        self.plan = options["plan"]
        self.tasks = int(options["tasks"])
        self.strict = options.get("errors", "skip") == "raise"

    def partitions(self):
        where, name = store(self.plan)
        with where.open_input_stream(name) as f:
            return runs([Group(**g) for g in json.loads(f.read())], self.tasks)

    def read(self, partition: Run):
        """A file is opened once for all groups of it that follow each other."""
        path, f, file = None, None, None
        try:
            for group in partition.groups:
                if group.path != path:
                    if f is not None:
                        f.close()
                    path, (f, file) = group.path, self._opened(group.path)
                if file is not None:
                    yield from self._rows(file, group)
        finally:
            if f is not None:
                f.close()

    def _opened(self, path: str):
        import pyarrow.parquet as pq

        f = None
        try:
            where, name = store(path)
            f = where.open_input_file(name)
            return f, pq.ParquetFile(f)
        except (OSError, pa.ArrowException):
            if self.strict:
                raise
            return f, None

    def _rows(self, file, group: Group) -> Iterator[pa.RecordBatch]:
        names = [n for n in self.arrow.names if n not in _PLACE_NAMES]
        row, left = 0, group.take
        for batch in file.iter_batches(row_groups=[group.row_group], columns=names):
            skip = min(max(group.skip - row, 0), batch.num_rows)
            rows = batch.slice(skip) if left < 0 else batch.slice(skip, left)
            if rows.num_rows:
                yield self._placed(rows, group, row + skip)
            left -= rows.num_rows if left >= 0 else 0
            row += batch.num_rows
            if left == 0:
                return

    def _placed(self, rows: pa.RecordBatch, at: Group, first: int) -> pa.RecordBatch:
        n = rows.num_rows
        more = {
            "file": lambda: pa.repeat(pa.scalar(at.path, pa.string()), n),
            "row_group": lambda: pa.repeat(pa.scalar(at.row_group, pa.int32()), n),
            "row_idx": lambda: pa.array(np.arange(first, first + n)),
            "global_row_group": lambda: pa.repeat(pa.scalar(at.ordinal, pa.int64()), n),
        }
        columns = [more[f.name]() if f.name in more else rows.column(rows.schema.get_field_index(f.name)).cast(f.type) for f in self.arrow]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)


_PLACE_NAMES = {f.split()[0] for f in PLACE.split(", ")}


class RowGroups(DataSource):
    """Read: ``plan`` is the path of the groups as JSON, the schema names the columns to read.  Write: see :class:`ExactWriter`."""

    @classmethod
    def name(cls):
        return FORMAT

    def reader(self, schema):
        return GroupReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return ExactWriter(self.options["path"], self.options["prefix"], int(self.options["rows_per_group"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RowGroups)


def _entries(manifest: DataFrame) -> list[tuple[str, int, int]]:
    return [tuple(r) for r in manifest.filter("num_row_groups > 0").select("path", "num_row_groups", "num_rows").collect()]


def read_groups(spark: SparkSession, groups: list[Group], columns: T.StructType | str, errors: str = "skip") -> DataFrame:
    """The columns of planned groups with their place: a partition a run of groups, and no other group is opened.

    The plan goes to a file in the shared folder, so its size isn't the query plan's.
    """
    register(spark)
    own = T._parse_datatype_string(columns) if isinstance(columns, str) else columns
    schema = T.StructType([*own.fields, *T._parse_datatype_string(PLACE).fields])
    path = f"{scratch(spark, 'groups')}.json"
    where, name = store(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as f:
        f.write(json.dumps([asdict(g) for g in groups]).encode())
    return spark.read.format(FORMAT).schema(schema).option("plan", path).option("tasks", str(TASKS * spark.sparkContext.defaultParallelism)).option("errors", errors).load()


def scan(spark: SparkSession, path: str, columns: T.StructType | str, manifest: DataFrame | None = None, errors: str = "skip", **order) -> DataFrame:
    """The known files of a folder by row groups; ``order`` is what :func:`plan` takes."""
    known = manifest if manifest is not None else existing_manifest(spark, path)
    if known is None:
        known = manifest_of(footers(listing(spark, path)))
    return read_groups(spark, plan(_entries(known), **order), columns, errors)


# --- the first n rows


def first_rows(spark: SparkSession, groups: DataFrame, columns: T.StructType | str, n: int, usable: Column | None = None, **order) -> tuple[DataFrame, dict]:
    """The first ``n`` rows, in order of the plan, that are usable, and (groups, rows, skipped) that were read for them.

    ``groups`` are :func:`footers`.  Running sums of the footers' row counts tell
    how many groups can hold what is still wanted; they are counted, and while
    rows are wanted the following ones are, so that groups behind the last row are
    never opened.  Only the last group is cut, by a window over that group.
    """
    sizes = {(r["path"], r["row_group"]): r["num_rows"] for r in groups.filter("error is null").collect()}
    entries = [(p, c, 0) for p, c in _per_file(sizes)]
    todo, used, have, counted = plan(entries, **order), [], 0, {}
    usable = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    while have < n and todo:
        upto = wanted = 0
        while upto < len(todo) and wanted < n - have:
            wanted += sizes[todo[upto].path, todo[upto].row_group] - todo[upto].skip
            upto += 1
        part, todo = todo[:upto], todo[upto:]
        found = read_groups(spark, part, columns).groupBy("global_row_group").agg(F.count_if(usable).alias("good"), F.count("*").alias("rows"))
        for r in found.collect():  # a row a group
            counted[r["global_row_group"]] = (r["good"], r["rows"])
        for g in part:
            if have < n:
                used.append(g)
                have += counted.get(g.ordinal, (0, 0))[0]
    rows = read_groups(spark, used, columns).filter(usable)
    seen = [counted.get(g.ordinal, (0, 0)) for g in used]
    told = {"groups": len(used), "rows": sum(r for _, r in seen), "skipped": sum(r - g for g, r in seen)}
    over = have - n
    if over > 0:
        last, keep = used[-1].ordinal, seen[-1][0] - over
        tail = rows.filter(F.col("global_row_group") == last).withColumn("_r", F.row_number().over(Window.orderBy("row_idx")))  # one group
        rows = rows.filter(F.col("global_row_group") < last).unionByName(tail.filter(F.col("_r") <= keep).drop("_r"))
    return rows, told


def _per_file(sizes: dict) -> list[tuple[str, int]]:
    counts: dict = {}
    for path, _ in sizes:
        counts[path] = counts.get(path, 0) + 1
    return sorted(counts.items())


def export_first(spark: SparkSession, path: str, out: str, columns: T.StructType | str, n: int, usable: Column | None = None, **order) -> dict:
    """Writes the first ``n`` usable rows of a folder as JSON lines; returns what was read and written."""
    rows, told = first_rows(spark, footers(listing(spark, path)), columns, n, usable, **order)
    rows.drop(*_PLACE_NAMES).write.json(out)
    return told
