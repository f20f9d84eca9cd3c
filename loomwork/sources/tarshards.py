"""Tar shards as a Python data source: ``spark.read.format("tarshards")`` and ``df.write.format("tarshards")``.

A shard ``shard-PPPPP-NNNNN.tar`` holds members ``scene/relpath``.  Reading
yields (shard, scene, member, content), a shard at a time; writing rolls a new
shard after ``max_scenes`` scenes, so rows of a scene should come together
(:func:`write_scenes` sees to that).

A folder's progress log says what is done: each write ends with one log part,
with a line for every (shard, scene).  Shards are written under a name of their
own task attempt, renamed at commit and then logged, so a run that fails at any
point leaves the log as it was; shards that no log names aren't read, and their
numbers are taken again.  A folder without a log is read whole.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomwork.sources.shared import store as _fs

LOG = "_log"
PROGRESS = "shard string, scene string, members bigint, bytes bigint, file_size_bytes bigint, md5 string"


class _Counted:
    """A stream that counts and digests what passes, so that a shard is never read again for its manifest."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.md5()

    def write(self, data: bytes) -> int:
        self.size += len(data)
        self.digest.update(data)
        return self.stream.write(data)

    def close(self) -> None:
        self.stream.close()


def logged(path: str) -> list[dict] | None:
    """The log's lines, a small one per scene; None where there is no log."""
    from pyarrow import fs

    store, base = _fs(f"{path.rstrip('/')}/{LOG}")
    if store.get_file_info(base).type == fs.FileType.NotFound:
        return None
    lines = []
    for f in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if f.base_name.startswith("part-"):
            with store.open_input_stream(f.path) as s:
                lines += [json.loads(x) for x in s.read().decode().splitlines() if x]
    return lines


@dataclass
class Shard(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class TarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        store, base = _fs(self.path)
        lines = logged(self.path)
        if lines is not None:
            paths = sorted({f"{base}/{x['shard']}" for x in lines})
        else:
            files = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            paths = sorted(f.path for f in files if f.path.endswith(".tar") and not f.base_name.startswith("."))
        return [Shard(p) for p in paths] or [Shard("")]

    def read(self, partition: Shard):
        if not partition.path:  # no shards yet
            return
        store, _ = _fs(self.path)
        name = partition.path.rsplit("/", 1)[-1]
        with store.open_input_stream(partition.path) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            for member in tar:
                if member.isfile():
                    scene, _, rest = member.name.partition("/")
                    yield name, scene, rest, tar.extractfile(member).read()


class TarWriter(DataSourceWriter):
    def __init__(self, path: str, max_scenes: int):
        self.path, self.max_scenes = path, max_scenes

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = _fs(self.path)
        store.create_dir(base, recursive=True)
        done, tar, stream, name, scenes, last = [], None, None, None, {}, None

        def close():
            tar.close()
            stream.close()
            done.append({"tmp": name, "scenes": scenes, "file_size_bytes": stream.size, "md5": stream.digest.hexdigest()})

        for scene, member, content in ((r["scene"], r["member"], r["content"]) for r in rows):
            if tar is None or (scene != last and len(scenes) >= self.max_scenes):
                if tar is not None:
                    close()
                scenes = {}
                name = f"{base}/.shard-{context.partitionId():05d}-{len(done):05d}.tar.{context.taskAttemptId()}"
                stream = _Counted(store.open_output_stream(name))
                tar = tarfile.open(fileobj=stream, mode="w|")
            last = scene
            members, size = scenes.get(scene, (0, 0))
            scenes[scene] = (members + 1, size + len(content))
            info = tarfile.TarInfo(f"{scene}/{member}")
            info.size = len(content)
            tar.addfile(info, io.BytesIO(bytes(content)))
        if tar is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        """Names the shards of this write after the logged ones, then logs them in one part."""
        import re

        from pyarrow import fs

        store, base = _fs(self.path)
        lines = logged(self.path)
        if lines is None:
            there = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
            names = [f.base_name for f in there]
        else:
            names = [x["shard"] for x in lines]
        taken = [int(m[1]) for m in (re.fullmatch(r"shard-(\d+)\.tar", n) for n in names) if m]
        number = max(taken, default=-1) + 1
        text = ""
        for f in sorted((f for m in messages if m for f in m.files), key=lambda f: f["tmp"]):
            name = f"shard-{number:05d}.tar"
            store.move(f["tmp"], f"{base}/{name}")
            number += 1
            for scene, (members, size) in f["scenes"].items():
                line = {"shard": name, "scene": scene, "members": members, "bytes": size, "file_size_bytes": f["file_size_bytes"], "md5": f["md5"]}
                text += json.dumps(line) + "\n"
        if text:
            store.create_dir(f"{base}/{LOG}", recursive=True)
            part = f"{base}/{LOG}/part-{number:05d}-{uuid.uuid4().hex[:8]}.json"
            with store.open_output_stream(part.replace("/part-", "/.part-")) as out:
                out.write(text.encode())
            store.move(part.replace("/part-", "/.part-"), part)

    def abort(self, messages) -> None:
        store, _ = _fs(self.path)
        for message in messages:
            for f in message.files if message else []:
                store.delete_file(f["tmp"])


class TarShards(DataSource):
    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return "shard string, scene string, member string, content binary"

    def reader(self, schema):
        return TarReader(self.options["path"])

    def writer(self, schema, overwrite):
        return TarWriter(self.options["path"], int(self.options.get("max_scenes", "100")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShards)


def write_scenes(files: DataFrame, path: str, max_scenes: int, partitions: int) -> None:
    """Writes (scene, member, content) rows; scenes stay whole."""
    register(files.sparkSession)
    rows = files.select("scene", "member", "content").repartition(partitions, "scene").sortWithinPartitions("scene", "member")
    rows.write.format("tarshards").option("path", path).option("max_scenes", max_scenes).mode("append").save()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The log: a row per (shard, scene) that a finished write holds."""
    from pyarrow import fs

    store, base = _fs(f"{path.rstrip('/')}/{LOG}")
    if store.get_file_info(base).type == fs.FileType.NotFound:
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).json(f"{path.rstrip('/')}/{LOG}/part-*")


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, scenes, num_scenes, file_size_bytes, md5) of all finished shards, from the log alone."""
    by = progress(spark, path).groupBy("shard")
    found = by.agg(F.array_sort(F.collect_set("scene")).alias("scenes"), F.first("file_size_bytes").alias("file_size_bytes"), F.first("md5").alias("md5"))
    return found.withColumn("num_scenes", F.size("scenes"))


def appended(spark: SparkSession, files: DataFrame, path: str, max_scenes: int, partitions: int) -> DataFrame:
    """Writes the scenes that the log doesn't have yet behind the shards that are there; returns the new scenes' log rows.

    The log is listed before the write and changes only when it is done, so what
    is written isn't looked for again, and a run after a failed one writes what
    that one didn't finish.
    """
    before = progress(spark, path).select("scene").distinct()
    parts = spark.read.format("text").load(f"{path.rstrip('/')}/{LOG}").inputFiles() if logged(path) is not None else []
    write_scenes(files.join(before, "scene", "left_anti"), path, max_scenes, partitions)
    log = progress(spark, path)
    if not parts:
        return log
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return log.filter(~name.isin([p.rsplit("/", 1)[-1] for p in parts]))
