"""A table of latest values that a stream keeps: buckets of keys, new versions of touched buckets, a pointer written last.

``path/data/N-xxxx/bucket=B`` holds version N of bucket B, ``path/pointers/N.json``
names the version of every bucket after batch N.  A batch reads and writes only
the buckets that its keys fall into.  What is written before its pointer is not
part of the table; a batch that is replayed after its pointer does nothing, and
one that failed before it writes anew.  Versions that no kept pointer names are
deleted by :func:`vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.shared import store

BUCKETS = 64


def _pointers(path: str) -> list[int]:
    from pyarrow import fs

    where, base = store(f"{path}/pointers")
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def pointer(path: str) -> tuple[int, dict[int, str]]:
    """(last batch, {bucket: folder}); (-1, {}) of a table that has no batch yet."""
    numbers = _pointers(path)
    if not numbers:
        return -1, {}
    where, name = store(f"{path}/pointers/{numbers[-1]}.json")
    with where.open_input_stream(name) as f:
        return numbers[-1], {int(b): v for b, v in json.loads(f.read()).items()}


def _point(path: str, number: int, folders: dict[int, str]) -> None:
    where, base = store(f"{path}/pointers")
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/.{number}.json") as f:
        f.write(json.dumps(folders).encode())
    where.move(f"{base}/.{number}.json", f"{base}/{number}.json")


def latest(spark: SparkSession, path: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets, as the last pointer has it."""
    _, folders = pointer(path)
    names = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def merge(batch: DataFrame, number: int, path: str, keys: list[str], value: str, arrival: str, buckets: int = BUCKETS) -> list[int]:
    """Puts a batch's last values into the table as version ``number``; returns the buckets that were rewritten.

    Of a key's values the one of the greatest ``arrival`` stays; null values
    don't count, as they say nothing.
    """
    done, folders = pointer(path)
    if number <= done:
        return []
    spark = batch.sparkSession
    columns = [*keys, value, arrival]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    own = batch.select(*columns).filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, arrival).alias(value), F.max(arrival).alias(arrival))
    new = own.withColumn("bucket", bucket).persist()
    try:
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most one row a bucket
        if touched:
            old = latest(spark, path, own.schema, touched).withColumn("bucket", bucket)
            both = old.unionByName(new).groupBy("bucket", *keys).agg(F.max_by(value, arrival).alias(value), F.max(arrival).alias(arrival))
            folder = f"{number}-{uuid.uuid4().hex[:8]}"
            both.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
            folders |= dict.fromkeys(touched, folder)
        _point(path, number, folders)
    finally:
        new.unpersist()
    return touched


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str, arrival: str, buckets: int = BUCKETS) -> None:
    """Runs a log's stream into the table until all that is there is taken."""

    def step(batch: DataFrame, number: int) -> None:
        merge(batch, number, path, keys, value, arrival, buckets)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def vacuum(path: str, pointers: int = 2) -> int:
    """Deletes versions that none of the last ``pointers`` pointers names, and older pointers; returns the number of folders deleted.

    Run it while no batch is written: one that has no pointer yet looks unused.
    """
    from pyarrow import fs

    numbers = _pointers(path)
    where, base = store(path)
    used = set()
    for n in numbers[-pointers:]:
        with where.open_input_stream(f"{base}/pointers/{n}.json") as f:
            used |= set(json.loads(f.read()).values())
    for n in numbers[:-pointers]:
        where.delete_file(f"{base}/pointers/{n}.json")
    unused = [f for f in where.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)) if f.base_name not in used]
    for f in unused:
        where.delete_dir(f.path)
    return len(unused)
