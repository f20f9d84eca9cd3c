"""Registered queries that write to the shared folder, run streams to their end and read back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans import catalog
from loomwork.plans.catalog import query
from loomwork.plans.tables import Tables
from loomwork.sources import rowgroups, shared, tarshards
from loomwork.streaming import epochs, packing, streams, versions

#: Orders laid out as files of 4,000 rows with 500 a group, in a seeded order.
_LAID_OUT = """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, '3')), o_orderkey) - 1 AS r FROM orders),
l AS (SELECT o_orderkey, 'orders_' || lpad((r // 4000)::VARCHAR, 5, '0') || '.parquet' AS file, ((r % 4000) // 500)::INTEGER AS row_group, r % 500 AS row_idx FROM p)"""
_OF_GROUPS = _LAID_OUT + """,
g AS (SELECT file, row_group, row_number() OVER (ORDER BY md5(file || ':' || row_group || ':11')) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT file, row_group FROM l))"""


def _orders(t: Tables) -> tuple[DataFrame, str]:
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    path = shared.scratch(t.spark, "orders")
    rowgroups.write_exact(orders, path, "orders", ["o_orderkey"], seed=3, rows_per_file=4000, rows_per_group=500)
    return orders, path


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query(_LAID_OUT + """ SELECT file, count(DISTINCT row_group)::INTEGER AS num_row_groups, count(*) AS num_rows, max(row_group) AS last_group, max(CASE WHEN row_group = 0 THEN row_idx END) + 1 AS first_rows FROM l GROUP BY file""")
def exact_files(t: Tables) -> DataFrame:
    """The manifest that the writer leaves, and what the executors find in the footers."""
    _, path = _orders(t)
    found = rowgroups.footers(rowgroups.listing(t.spark, path))
    seen = found.groupBy("path").agg(F.max("row_group").alias("last_group"), F.max(F.when(F.col("row_group") == 0, F.col("num_rows"))).alias("first_rows"))
    both = rowgroups.existing_manifest(t.spark, path).join(seen, "path")
    return both.select(F.element_at(F.split("path", "/"), -1).alias("file"), "num_row_groups", "num_rows", "last_group", "first_rows")


@query(_LAID_OUT + """ SELECT o_orderkey, file, row_group, row_idx FROM l WHERE file > 'orders_00000.parquet' OR row_group > 1 OR row_group = 1 AND row_idx > 77""")
def row_group_cursor(t: Tables) -> DataFrame:
    _, path = _orders(t)
    rows = rowgroups.scan(t.spark, path, "o_orderkey bigint", after=(f"{path}/orders_00000.parquet", 1, 77))
    return _placed(rows).select("o_orderkey", "file", "row_group", "row_idx")


@query(_OF_GROUPS + """ SELECT o_orderkey, l.file, l.row_group, row_idx, place - n // 3 AS global_row_group FROM l JOIN g ON l.file = g.file AND l.row_group = g.row_group WHERE place >= n // 3 AND place < 2 * n // 3""")
def row_group_order(t: Tables) -> DataFrame:
    """The second of three ranks' groups, in a seeded order; a file that the manifest doesn't know isn't read."""
    orders, path = _orders(t)
    orders.limit(5).withColumn("o_orderkey", F.lit(-1).cast("bigint")).write.mode("append").parquet(path)
    rows = rowgroups.scan(t.spark, path, "o_orderkey bigint", seed=11, rank=1, world=3)
    return _placed(rows).select("o_orderkey", "file", "row_group", "row_idx", "global_row_group")


@query(_OF_GROUPS + """, u AS (SELECT o.o_orderkey, o.o_totalprice, place, row_number() OVER (ORDER BY place, row_idx) AS k FROM l JOIN g ON l.file = g.file AND l.row_group = g.row_group JOIN orders o ON o.o_orderkey = l.o_orderkey WHERE o.o_totalprice > 1500)
SELECT o_orderkey, o_totalprice FROM u WHERE k <= 1234""")
def export_first_n(t: Tables) -> DataFrame:
    """The first 1,234 dear orders in a seeded order of groups, as JSON lines; groups behind the last one aren't opened."""
    _, path = _orders(t)
    out = shared.scratch(t.spark, "export")
    rowgroups.export_first(t.spark, path, out, "o_orderkey bigint, o_totalprice double", 1234, F.col("o_totalprice") > 1500, seed=11)
    return t.spark.read.schema("o_orderkey bigint, o_totalprice double").json(out)


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS early, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, '3')), o_orderkey) - 1 AS r FROM orders),
n AS (SELECT (count(*) + 3999) // 4000 AS files FROM p WHERE early)
SELECT o_orderkey, 'orders_' || lpad((r // 4000 + CASE WHEN early THEN 0 ELSE files END)::VARCHAR, 5, '0') || '.parquet' AS file, ((r % 4000) // 500)::INTEGER AS row_group FROM p, n""")
def resumed_files(t: Tables) -> DataFrame:
    """Half of the orders are written, then all are asked for: the manifest says what is missing and which number is next."""
    orders = t.orders.select("o_orderkey", "o_totalprice")
    path = shared.scratch(t.spark, "orders")
    for rows in (orders.filter("o_orderkey % 2 = 0"), orders):
        rowgroups.resume_exact(rows, path, "orders", ["o_orderkey"], seed=3, rows_per_file=4000, rows_per_group=500)
    return _placed(rowgroups.scan(t.spark, path, "o_orderkey bigint")).select("o_orderkey", "file", "row_group")


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', doc_id::VARCHAR, '3')), doc_id) - 1 AS r FROM documents),
l AS (SELECT doc_id, 'docs_' || lpad((r // 400)::VARCHAR, 5, '0') || '.parquet' AS file, (r % 400) // 100 AS row_group, epoch FROM p, range(0, 3) t(epoch))
SELECT epoch, doc_id, dense_rank() OVER (PARTITION BY epoch ORDER BY md5(file || ':' || row_group || ':5:' || epoch)) - 1 AS global_row_group,
 (row_number() OVER (PARTITION BY epoch, file, row_group ORDER BY md5(doc_id || ':5:' || epoch)) - 1)::INTEGER AS pos FROM l""")
def epoch_shuffles(t: Tables) -> DataFrame:
    """Three epochs as a stream, a run a trigger, so that every run resumes in the middle of an epoch; runs of many groups, so their number stays."""
    docs = t.documents.select("doc_id", "lang")
    path = shared.scratch(t.spark, "docs")
    rowgroups.write_exact(docs, path, "docs", ["doc_id"], seed=3, rows_per_file=400, rows_per_group=100)
    known = rowgroups.existing_manifest(t.spark, path)
    groups = known.agg(F.sum("num_row_groups")).first()[0] or 0
    step = max(37, 3 * groups // 20)
    stream = epochs.epochs(t.spark, known, "doc_id bigint", "doc_id", f"{path}-cursor/at.json", seed=5, groups_per_trigger=step, last=3)
    epochs.run_epochs(stream, f"{path}-read", f"{path}-progress", 3 * docs.count())
    return t.spark.read.schema(stream.schema).parquet(f"{path}-read").select("epoch", "doc_id", "global_row_group", "pos")


@query("""SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""")
def latest_values(t: Tables) -> DataFrame:
    """A log in four files, a batch each, kept as a table of last values in buckets behind a pointer."""
    log = shared.scratch(t.spark, "log")
    events = t.events.select("user_id", "event_type", "value", "event_id")
    events.repartition(4, "event_id").write.parquet(log)
    versions.keep_latest(streams.files(t.spark, log, events.schema, per_trigger=1), f"{log}-table", f"{log}-progress", ["user_id", "event_type"], "value", "event_id", buckets=16)
    return versions.latest(t.spark, f"{log}-table", events.schema)


def _streamed(t: Tables, budget, mandatory: tuple[str, ...] = ()) -> DataFrame:
    """Samples that arrive in two parts, the query ending in between, and then each shard's end mark."""
    samples = catalog._samples(t).withColumn("grp", F.col("lang")).withColumn("last", F.lit(False)).drop("lang")
    path = shared.scratch(t.spark, "samples")
    schema = packing.SAMPLES
    shaped = samples.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
    ends = shaped.select("shard").distinct().select("shard", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")[1:-1]], F.lit(True).alias("last"))
    half = shaped.agg((F.max("rn") / 2).cast("bigint")).first()[0]
    with packing.with_state_store(t.spark):
        for part in (shaped.filter(F.col("rn") <= half), shaped.filter(F.col("rn") > half).unionByName(ends)):
            part.write.mode("append").parquet(path)
            stream = streams.files(t.spark, path, shaped.schema, per_trigger=10_000)
            streams.run_once(packing.packed(stream, budget, mandatory), f"{path}-places", f"{path}-progress")
    return t.spark.read.parquet(f"{path}-places")


@query(catalog._PACK_BUFFERED)
def pack_stream_buffered(t: Tables) -> DataFrame:
    return _streamed(t, catalog.BUFFERED)


@query(catalog._PACK_MANDATORY)
def pack_stream_mandatory(t: Tables) -> DataFrame:
    return _streamed(t, catalog.BUDGET, ("de", "fr"))


@query("""SELECT 's' || page_id % 37 AS scene, count(*) AS members, sum(octet_length(encode(url)))::BIGINT AS bytes, 1::BIGINT AS shards, true AS whole FROM pages GROUP BY 1""")
def scenes_once(t: Tables) -> DataFrame:
    """Half of the scenes, a run that breaks off in its last scene, and a run over all: each scene is in the log and in a shard once."""
    pages = t.pages.select((F.concat(F.lit("s"), (F.col("page_id") % 37).cast("string"))).alias("scene"), F.concat("page_id", F.lit(".txt")).alias("member"), F.col("url").cast("binary").alias("content"))
    path = shared.scratch(t.spark, "scenes")
    tarshards.appended(t.spark, pages.filter("scene < 's2'"), path, max_scenes=4, partitions=2)
    broken = pages.withColumn("content", F.when(F.col("scene") == "s9", F.raise_error(F.lit("breaks off")).cast("binary")).otherwise(F.col("content")))
    try:
        tarshards.appended(t.spark, broken, path, max_scenes=4, partitions=2)
    except Exception as e:
        if "breaks off" not in str(e):
            raise
    tarshards.appended(t.spark, pages, path, max_scenes=4, partitions=2)
    tarshards.register(t.spark)
    held = t.spark.read.format("tarshards").option("path", path).load().groupBy("scene").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("size"))
    log = tarshards.progress(t.spark, path).groupBy("scene").agg(F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"))
    both = log.join(held, "scene")
    return both.select("scene", "members", "bytes", "shards", ((F.col("n") == F.col("members")) & (F.col("size") == F.col("bytes"))).alias("whole"))
