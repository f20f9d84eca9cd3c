"""Readers of annotation files: every one is a lazy scan, and rows it can't use are told apart, not raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import geometry
from loomwork.operators.ordering import counted, numbered, numbered_by, order_key
from loomwork.sources.shared import store

SAMPLE_SCHEMA = (
    "question string, answer string, scene_name string, dataset_name string, image_path array<string>, "
    "poses array<array<double>>, intrinsic array<double>, depth_intrinsic array<double>, metadata string"
)
SAMPLE_3D_SCHEMA = SAMPLE_SCHEMA + ", depth_list array<string>, world_coords string, boundary array<double>, objects string"


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows): the Parquet files under a path, in any store that Spark reads."""
    scan = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return scan.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows")).orderBy("path")


def rows_from(spark: SparkSession, path: str, after: tuple[str, int] | None = None) -> DataFrame:
    """A Parquet scan with ``file`` and ``row``; with ``after`` only what comes behind that (file, row) cursor."""
    scan = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    scan = scan.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if after is None:
        return scan
    file, row = after
    return scan.filter((F.col("file") > file) | ((F.col("file") == file) & (F.col("row") > row)))


def row_groups(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, row_group): all row groups of the files that the manifest (path, num_row_groups) knows."""
    known = manifest.filter("num_row_groups > 0")
    return files.select("path").join(known, "path").select("path", F.explode(F.sequence(F.lit(0), F.col("num_row_groups").cast("int") - 1)).alias("row_group"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, num_row_groups, num_rows) of a manifest JSON {path: {num_row_groups, num_rows}}."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string,struct<num_row_groups:int,num_rows:bigint>>")
    return text.select(F.explode(pairs).alias("path", "m")).select("path", "m.*")


def json_records(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON arrays, JSON objects and JSON lines, told apart for each file by its first line.

    A file whose first line begins an array, or an object that doesn't end in that
    line, is parsed whole; all others are JSON lines and cut into splits.  Of the
    first kind the driver holds the paths.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = spark.read.text(path).select(F.trim("value").alias("value"), file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"))
    firsts = rows.filter("value <> ''").groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("value"))
    is_whole = F.col("value").startswith("[") | (F.col("value").startswith("{") & F.try_parse_json("value").isNull() & ~F.col("value").endswith("}"))
    whole_files = [r["file"] for r in firsts.filter(is_whole).select("file").collect()]
    lines = rows.filter("value <> ''").select("value", "file")
    if whole_files:
        lines = lines.join(firsts.filter(is_whole).select("file"), "file", "left_anti")
    parsed = lines.select("value", F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r"))
    bad = F.try_parse_json("value").isNull() | F.col("r").isNull()
    good, rejects = parsed.filter(~bad).select("r.*"), parsed.filter(bad).select("value", F.lit("malformed").alias("reason"))
    if whole_files:
        text = spark.read.text(whole_files, wholetext=True).select(F.trim("value").alias("value"))
        as_array = F.when(F.ltrim("value").startswith("{"), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
        lists = text.select("value", F.from_json(as_array, T.ArrayType(kind), {"mode": "PERMISSIVE"}).alias("rs"))
        good = good.unionByName(lists.filter("rs is not null").select(F.explode("rs").alias("r")).select("r.*"))
        rejects = rejects.unionByName(lists.filter("rs is null").select("value", F.lit("malformed").alias("reason")))
    return good, rejects


def mixed(spark: SparkSession, datasets: list[dict], schema: str) -> DataFrame:
    """All records of a mix config [{name, annotation, root}], with ``dataset_name`` and ``root``."""
    out = None
    for d in datasets:
        good, _ = json_records(spark, d["annotation"], schema)
        one = good.withColumns({"dataset_name": F.lit(d["name"]), "root": F.lit(d.get("root", ""))})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("an empty mix")
    return out


def _few_tasks(files: DataFrame) -> DataFrame:
    """Small files, of which Spark gives a task some dozens, in as many tasks as the cores want, however many files there are."""
    return files.coalesce(3 * files.sparkSession.sparkContext.defaultParallelism)


def with_any_key(spark: SparkSession, path: str, keys: list[str], least: int, most: int, head: int = 1 << 20) -> DataFrame:
    """(path, length, role): unnamed blobs in a size window whose first line holds one of the keys.

    Of a blob only its first line is read, by the executors and through Arrow's
    file systems; one of over ``head`` bytes has no role.
    """
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            lines = []
            for name in batch.column(0).to_pylist():
                where, at = store(name)
                with where.open_input_stream(at) as f:
                    data = b""
                    while b"\n" not in data and len(data) < head and (more := f.read(min(65_536, head - len(data)))):
                        data += more
                lines.append(data.split(b"\n", 1)[0].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.string())], names=["path", "length", "line"])

    blobs = spark.read.format("binaryFile").load(path).select("path", "length").filter(F.col("length").between(least, most))
    firsts = _few_tasks(blobs).mapInArrow(read, "path string, length bigint, line string")
    role = F.coalesce(*[F.when(F.get_json_object("line", f"$.{k}").isNotNull(), F.lit(k)) for k in keys])
    return firsts.select("path", "length", role.alias("role")).filter("role is not null")


def scene_folders(spark: SparkSession, path: str, pattern: str = "*", least: int = 1, most: int = 1 << 30) -> DataFrame:
    """(scene, frames): sorted file paths by folder, of folders with so many files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    files = _few_tasks(files)
    scene = F.element_at(F.split("path", "/"), -2)
    found = files.groupBy(scene.alias("scene")).agg(F.array_sort(F.collect_list("path")).alias("frames"))
    return found.filter(F.size("frames").between(least, most))


def _fields(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, pose): lines of 7 numbers (time, axis-angle, translation) as 4x4 poses; other lines are passed over."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.transform(_fields(F.col("value")), lambda x: x.try_cast("double")).alias("f"))
    good = lines.filter((F.size("f") == 7) & ~F.exists("f", lambda x: x.isNull()))
    turn, move = F.slice("f", 2, 3), F.slice("f", 5, 3)
    return good.select("file", F.get("f", F.lit(0)).alias("ts"), geometry.pose_of(geometry.matrix_of_axis_angle(turn), move).alias("pose"))


def pinhole_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, k): files of ``w h fx fy cx cy``."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.transform(_fields(F.col("value")), lambda x: x.try_cast("double")).alias("f")).filter("size(f) >= 6")
    at = lambda i: F.get("f", F.lit(i))
    return rows.select("file", at(0).cast("int").alias("width"), at(1).cast("int").alias("height"), geometry.intrinsics(at(2), at(3), at(4), at(5)).alias("k"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, pos, value): lines with their number in the file from 0, and the file's first line.

    Lines are numbered in the splits that Spark reads, and counts of earlier
    splits are added, so no task and no row holds a file.
    """
    file, split = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = spark.read.option("lineSep", "\n").text(path).select("value", file.alias("file"), split.alias("_split"), F.monotonically_increasing_id().alias("_at"))
    of_file = Window.partitionBy("file").orderBy("_split")
    splits = rows.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min_by("value", "_at").alias("_head"))
    before = F.coalesce(F.sum("_n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_split", before.alias("_before"), F.first("_head").over(of_file).alias("first"))
    at = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at"))
    return rows.withColumn("_r", at).join(splits, ["file", "_split"]).select("file", "first", (F.col("_before") + F.col("_r") - 1).cast("int").alias("pos"), "value")


def camera_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, url, pos, ts, intrinsics, extrinsics): a URL line, then lines of at least 19 numbers."""
    lines = _numbered_lines(spark, path).filter("pos > 0").select("file", F.trim("first").alias("url"), "pos", _fields(F.col("value")).alias("f"))
    rows = lines.filter("size(f) >= 19")
    numbers = F.transform(F.slice("f", 2, 18), lambda x: x.cast("double"))
    return rows.select("file", "url", "pos", F.get("f", F.lit(0)).cast("bigint").alias("ts"), F.slice(numbers, 1, 6).alias("intrinsics"), F.slice(numbers, 7, 12).alias("extrinsics"))


def benchmark_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated question table: the image as bytes, options as a map of those that are there."""
    raw = spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"')
    for c in ("A", "B", "C", "D", "E", "hint", "answer"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    options = F.map_filter(F.create_map(*[x for c in "ABCDE" for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return raw.withColumn("options", options).withColumn("image", F.unbase64("image")).drop(*"ABCDE")


def tab_lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated text without quoting; rows with another number of fields are dropped."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") == len(names))
    return parts.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def arrow_streams(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow IPC stream or file blobs, one blob in memory at a time."""
    import pyarrow as pa

    kind = T._parse_datatype_string(schema)
    names = kind.names

    def read(batches):
        for batch in batches:
            for blob in batch.column(0):
                data = pa.py_buffer(blob.as_py())
                try:
                    reader = pa.ipc.open_stream(data)
                    found = list(reader)
                except pa.ArrowInvalid:
                    opened = pa.ipc.open_file(data)
                    found = [opened.get_batch(i) for i in range(opened.num_record_batches)]
                for b in found:
                    yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, kind)


def captioned(df: DataFrame, column: str, key: str, seed) -> DataFrame:
    """Adds ``caption``: one of the captions in a JSON object {name: caption}, by a hash of key and seed; a blank without any."""
    texts = F.map_values(F.from_json(column, "map<string,string>"))
    texts = F.filter(texts, lambda x: x.isNotNull())
    at = F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("bigint") % F.size(texts)
    return df.withColumn("caption", F.when(F.size(texts) > 0, F.get(texts, at.cast("int"))).otherwise(F.lit(" ")))


def shuffled_prefix(df: DataFrame, keys: list[str], seed, n: int | None = None, share: float | None = None) -> DataFrame:
    """The first ``n`` rows, or a share of them, of a seeded shuffle, with ``rn`` from 1; no task holds more than a range of them."""
    placed = numbered(df.withColumn("_k", order_key(seed, *keys)), "_k", keys).drop("_k")
    return placed.filter(F.col("rn") <= (n if n is not None else int(df.count() * share)))


def prefix(df: DataFrame, order: list[str], n: int | None = None, share: float | None = None) -> DataFrame:
    """The first ``n`` rows, or a share of them, in an order that the caller names."""
    if n is not None:
        return df.orderBy(*order).limit(n)
    total = df.count()
    return df.orderBy(*order).limit(int(total * share))


def ranks_of(files: DataFrame, world: int) -> DataFrame:
    """Files (path) with their ``rank``: chunks of ceil(n / world) in order of path; all ranks together are all files."""
    placed = counted(numbered_by(files, ["path"], number="_i"), name="_n")
    return placed.withColumn("rank", F.floor((F.col("_i") - 1) / F.ceil(F.col("_n") / world)).cast("int")).drop("_i", "_n")


def ranked_files(files: DataFrame, rank: int, world: int) -> DataFrame:
    """The files of one rank."""
    return ranks_of(files, world).filter(F.col("rank") == rank).drop("rank")


def pickled_scenes(spark: SparkSession, path: str, of: str = "data_list") -> DataFrame:
    """(file, value): the items of pickled {``of``: [item, ...]} files as JSON, arrays as lists.

    Only plain values and numeric arrays are read; a pickle that names anything
    else is an error, as reading it could run its code.
    """
    import io
    import json as js
    import pickle

    import pyarrow as pa

    # What numeric arrays are made of.
    known = {("numpy", "ndarray"), ("numpy", "dtype"), *((f"numpy.{c}.multiarray", f) for c in ("core", "_core") for f in ("_reconstruct", "scalar")), *((f"numpy.{c}.numeric", "_frombuffer") for c in ("core", "_core"))}

    class Plain(pickle.Unpickler):
        def find_class(self, module, name):
            if (module, name) not in known:
                raise pickle.UnpicklingError(f"{module}.{name} isn't a plain value")
            return super().find_class(module, name)

    def plain(x):
        return x.tolist() if hasattr(x, "tolist") else str(x)

    def read(batches):
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                items = Plain(io.BytesIO(blob.as_py())).load()[of]
                for at in range(0, len(items), 1000):
                    texts = [js.dumps(x, default=plain, ensure_ascii=False) for x in items[at : at + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(texts, pa.string())], names=["file", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "file string, value string")


def zip_members(spark: SparkSession, path: str, pattern: str = r".*", run: int = 32 << 20) -> DataFrame:
    """(archive, member, content) of zip files; member names are matched against a pattern.

    A task lists an archive from its directory, an entry a member.  The members
    are then read where they lie, by runs of ``run`` bytes of an archive, so no
    task holds an archive and an archive is many tasks' work.
    """
    import re
    import struct
    import zipfile
    import zlib

    import pyarrow as pa

    wanted = re.compile(pattern)
    entries = pa.schema([("archive", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("method", pa.int32())])
    contents = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def listed(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, at = store(name)
                with where.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    found = [m for m in z.infolist() if not m.is_dir() and wanted.fullmatch(m.filename)]
                for i in range(0, len(found), 10_000):
                    # an encrypted member has no method that is read here
                    rows = [(name, m.filename, m.header_offset, m.compress_size, m.CRC, -1 if m.flag_bits & 1 else m.compress_type) for m in found[i : i + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), entries.types)], schema=entries)

    def one(f, others: dict, at: int, size: int, crc: int, method: int) -> bytes:
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            with zipfile.ZipFile(f) as z:
                others.update({m.header_offset: m for m in z.infolist()} if not others else {})
                return z.read(others[at])
        f.seek(at)
        name, extra = struct.unpack("<2H", f.read(30)[26:])
        f.seek(at + 30 + name + extra)
        data = f.read(size)
        data = data if method == zipfile.ZIP_STORED else zlib.decompress(data, -15)
        if zlib.crc32(data) != crc:
            raise zipfile.BadZipFile(f"a member at {at} has another checksum")
        return data

    def read(batches):
        archive, f, others = None, None, {}
        for batch in batches:
            held, size = [], 0
            for name, member, *place in zip(*(c.to_pylist() for c in batch.columns)):
                if name != archive:
                    if f is not None:
                        f.close()
                    where, path_in = store(name)
                    archive, f, others = name, where.open_input_file(path_in), {}
                held.append((name, member, one(f, others, *place)))
                size += len(held[-1][2])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), contents.types)], schema=contents)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), contents.types)], schema=contents)
        if f is not None:
            f.close()

    tasks = 3 * spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path").repartition(tasks)
    members = files.mapInArrow(listed, "archive string, member string, at bigint, size bigint, crc bigint, method int")
    runs = members.repartition(tasks, "archive", F.floor(F.col("at") / run)).sortWithinPartitions("archive", "at")
    return runs.mapInArrow(read, "archive string, member string, content binary")


def folder_or_zip(spark: SparkSession, path: str, pattern: str = r".*") -> DataFrame:
    """(archive, member, content): the files of a folder; where it has none that match, those of its zip files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    plain = files.filter(~F.col("path").endswith(".zip") & name.rlike(f"^(?:{pattern})$"))
    if plain.select("path").isEmpty():  # contents aren't read for it
        return zip_members(spark, path, pattern)
    return plain.select(F.lit(None).cast("string").alias("archive"), name.alias("member"), "content")
