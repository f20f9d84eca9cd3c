"""Registered queries of benchmark reports, captions, prefixes, ranks, overlaps, posed pixels and streams under watermarks, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import geometry
from loomwork.operators import joins, metrics, similarity
from loomwork.plans.catalog import query
from loomwork.plans.tables import Tables
from loomwork.sources import readers, shared, sinks
from loomwork.streaming import streams


def _c(name: str) -> Column:
    return F.col(name)


# --- reports

_TYPES = {"first": ["0", "1", "2"], "second": ["3", "4"]}
_PAIRS = """WITH q AS (SELECT (l_orderkey % 6)::VARCHAR AS task, l_orderkey * 10 + (l_linenumber - 1) // 2 AS image, CASE WHEN l_quantity >= 25 THEN 'yes' ELSE 'no' END AS g, CASE l_suppkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'No' ELSE CASE WHEN l_discount >= 0.03 THEN 'Yes' ELSE 'no' END END AS p FROM lineitem),
t AS (SELECT *, CASE WHEN task IN ('0', '1', '2') THEN 'first' WHEN task IN ('3', '4') THEN 'second' END AS type, lower(p) AS a FROM q),
i AS (SELECT type, task, image, count(*) AS n, count(*) FILTER (g = a) AS ok FROM t WHERE type IS NOT NULL GROUP BY ALL),
k AS (SELECT type, task, sum(ok) / sum(n) AS acc, count(*) FILTER (ok = 2) / count(*) AS acc_plus FROM i GROUP BY ALL),
c AS (SELECT type, task, count(*) FILTER (g = 'yes' AND a = 'yes') AS tp, count(*) FILTER (g = 'yes' AND a = 'no') AS fn, count(*) FILTER (g = 'no' AND a = 'yes') AS fp, count(*) FILTER (g = 'no' AND a = 'no') AS tn, count(*) FILTER (a = 'other') AS other_num FROM t WHERE type IS NOT NULL GROUP BY ALL)"""


@query(_PAIRS + """ SELECT c.type, c.task, tp AS "TP", fn AS "FN", fp AS "FP", tn AS "TN", other_num, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(acc, 6) AS acc, round(acc_plus, 6) AS acc_plus, round(100 * (acc + acc_plus), 4) AS score FROM c JOIN k ON c.task = k.task
UNION ALL SELECT type, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(sum(100 * (acc + acc_plus)), 4) FROM k GROUP BY type""")
def paired_report(t: Tables) -> DataFrame:
    gold = F.when(_c("l_quantity") >= 25, "yes").otherwise(F.lit("no"))
    said = F.when(_c("l_suppkey") % 7 == 0, "other").when(_c("l_suppkey") % 7 == 1, "No").when(_c("l_discount") >= 0.03, "Yes").otherwise(F.lit("no"))
    rows = t.lineitem.select((_c("l_orderkey") % 6).cast("string").alias("task"), (_c("l_orderkey") * 10 + F.floor((_c("l_linenumber") - 1) / 2)).alias("image"), gold.alias("g"), said.alias("p"))
    out = metrics.paired_report(rows, "task", "image", _c("g"), _c("p"), _TYPES)
    places = {"precision": 6, "recall": 6, "acc": 6, "acc_plus": 6, "score": 4}
    return out.select("type", "task", "TP", "FN", "FP", "TN", "other_num", *[F.round(c, n).alias(c) for c, n in places.items()])


@query("""WITH d AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'SMALL' THEN 'low' WHEN 'STANDARD' THEN 'high' WHEN 'PROMO' THEN 'high' END AS domain, p_type, (p_size >= 20)::INTEGER AS c FROM part),
r AS (SELECT domain, p_type, grouping_id(domain, p_type) AS g, count(*) AS num, avg(c) AS acc FROM d WHERE domain IS NOT NULL GROUP BY GROUPING SETS ((domain, p_type), (domain), ()))
SELECT CASE g WHEN 0 THEN p_type WHEN 1 THEN 'Overall-' || domain ELSE 'Overall' END AS name, CASE g WHEN 0 THEN 'category' WHEN 1 THEN 'domain' ELSE 'all' END AS level, num, round(acc, 3) AS acc FROM r
UNION ALL SELECT 'Overall-none', 'domain', 0, 0.0""")
def domain_report(t: Tables) -> DataFrame:
    domains = {"low": ["ECONOMY", "SMALL"], "high": ["STANDARD", "PROMO"], "none": ["UNKNOWN"]}
    return metrics.domain_report(t.part, "p_type", _c("p_size") >= 20, domains)


@query("""WITH r AS (SELECT 'brand' AS key, p_brand AS value, avg((p_size >= 20)::INTEGER) AS acc, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, avg((p_size >= 20)::INTEGER), count(*) FROM part GROUP BY p_type),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY acc DESC, value) AS place FROM r)
SELECT 'key: ' || key || ', place: ' || place || ', value: ' || value || ', n: ' || n AS line FROM p""")
def best_first_report(t: Tables) -> DataFrame:
    """Accuracy by brand and by type, the best first, written as text lines and read back."""
    rows = t.part.select(_c("p_brand").alias("brand"), _c("p_type").alias("type"), "p_size")
    by = metrics.by_attributes(rows, ["brand", "type"], _c("p_size") >= 20)
    ordered = metrics.best_first(by, "key", "acc", ["value"])
    path = shared.scratch(t.spark, "report")
    sinks.write_report(ordered.select("key", "place", "value", "n"), path, "txt", ["key", "place"])
    return t.spark.read.text(path).select(_c("value").alias("line"))


# --- captions, prefixes, ranks, defaults


@query("""WITH c AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 5 <> 0 THEN p_name END, CASE WHEN p_size % 3 <> 0 THEN p_type || ' "x"' END, CASE WHEN p_size % 2 <> 0 THEN p_brand END], lambda x: x IS NOT NULL) AS texts FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 OR len(texts) = 0 THEN ' ' ELSE texts[1 + ('0x' || left(md5(p_partkey || ':6'), 8))::BIGINT % len(texts)] END AS caption FROM c""")
def picked_captions(t: Tables) -> DataFrame:
    """One of up to three captions in a JSON object; rows whose JSON is broken or empty have a blank."""
    some = F.struct(F.when(_c("p_size") % 5 != 0, _c("p_name")).alias("short"), F.when(_c("p_size") % 3 != 0, F.concat("p_type", F.lit(' "x"'))).alias("long"), F.when(_c("p_size") % 2 != 0, _c("p_brand")).alias("alt"))
    text = F.when(_c("p_partkey") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(some))
    return readers.captioned(t.part.select("p_partkey", text.alias("captions")), "captions", "p_partkey", 6).select("p_partkey", "caption")


@query("""SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':8'), o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE rn <= floor(n * 0.37)""")
def shuffled_prefix(t: Tables) -> DataFrame:
    return readers.shuffled_prefix(t.orders.select("o_orderkey"), ["o_orderkey"], 8, share=0.37).select("o_orderkey", "rn")


@query("""WITH f AS (SELECT DISTINCT source || '/' || lang AS path FROM documents), p AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i, count(*) OVER () AS n FROM f)
SELECT path, (i // ((n + 6) // 7))::INTEGER AS rank FROM p""")
def files_of_ranks(t: Tables) -> DataFrame:
    files = t.documents.select(F.concat("source", F.lit("/"), "lang").alias("path")).distinct()
    return readers.ranks_of(files, 7)


@query("""WITH r AS (SELECT p_brand AS k, max(p_size) AS size FROM part GROUP BY 1) SELECT o_orderkey, coalesce(a.size, b.size, -1)::INTEGER AS size FROM orders LEFT JOIN r a ON a.k = 'Brand#' || (o_orderkey % 40) LEFT JOIN r b ON b.k = 'Brand#' || (o_custkey % 30)""")
def repeated_defaults(t: Tables) -> DataFrame:
    """A right table that repeats its keys: no order is repeated, and the greatest value counts."""
    orders = t.orders.select("o_orderkey", F.concat(F.lit("Brand#"), _c("o_orderkey") % 40).alias("a"), F.concat(F.lit("Brand#"), _c("o_custkey") % 30).alias("b"))
    found = joins.with_default(orders, t.part.select("p_brand", _c("p_size").alias("size")), ["a", "b"], "p_brand", "size", F.lit(-1))
    return found.select("o_orderkey", "size")


# --- overlaps and posed pixels


@query("""WITH RECURSIVE b AS (SELECT label, vec_id, vec_id % 89 / 100.0 + vec_id / 1e6 AS score, vec_id % 5 * 4.0 AS x, vec_id % 3 * 5.0 AS y FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC) AS i FROM b WHERE score > 0.3),
k AS (SELECT label, 0::BIGINT AS i, []::STRUCT(x DOUBLE, y DOUBLE, id BIGINT)[] AS kept FROM (SELECT DISTINCT label FROM o) UNION ALL
 SELECT k.label, o.i, CASE WHEN list_bool_or(list_transform(kept, lambda q: w(q.x, o.x) * w(q.y, o.y) / (200 - w(q.x, o.x) * w(q.y, o.y)) >= 0.3)) THEN kept ELSE list_append(kept, {'x': o.x, 'y': o.y, 'id': o.vec_id}) END FROM k JOIN o ON o.label = k.label AND o.i = k.i + 1 WHERE o.i <= 16)
SELECT label::VARCHAR AS img, unnest(kept).id AS vec_id FROM (SELECT label, arg_max(kept, i) AS kept FROM k GROUP BY label)""".replace("w(q.x, o.x)", "greatest(10 - abs(q.x - o.x), 0)").replace("w(q.y, o.y)", "greatest(10 - abs(q.y - o.y), 0)"))
def suppressed_overlaps(t: Tables) -> DataFrame:
    """Boxes of ten by ten cells that overlap partly, at a limit of 0.3."""
    x, y = (_c("vec_id") % 5) * 4.0, (_c("vec_id") % 3) * 5.0
    score = _c("vec_id") % 89 / 100.0 + _c("vec_id") / 1e6
    found = t.embeddings.select(_c("label").cast("string").alias("img"), F.lit("c").alias("cls"), score.alias("score"), F.array(x, y, x + 9, y + 9).alias("box"))
    kept = similarity.suppressed(found, limit=0.3)
    ids = t.embeddings.select(_c("label").cast("string").alias("img"), score.alias("score"), "vec_id")
    return kept.join(ids, ["img", "score"]).select("img", "vec_id")


@query("""WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id, e, e[1] / l AS w, e[2] / l AS x, e[3] / l AS y, e[4] / l AS z FROM (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) AS l FROM f)),
c AS (SELECT *, (100 + vec_id % 50)::DOUBLE AS u, (80 + vec_id % 30)::DOUBLE AS v, (500 + vec_id % 1000) / 1000.0 AS d FROM q), p AS (SELECT *, (u - 160) * d / 300 AS cx, (v - 120) * d / 310 AS cy FROM c)
SELECT vec_id, round((1 - 2 * (y * y + z * z)) * cx + 2 * (x * y - w * z) * cy + 2 * (x * z + w * y) * d + e[5], 6) AS px, round(2 * (x * y + w * z) * cx + (1 - 2 * (x * x + z * z)) * cy + 2 * (y * z - w * x) * d + e[6], 6) AS py,
 round(2 * (x * z - w * y) * cx + 2 * (y * z + w * x) * cy + (1 - 2 * (x * x + y * y)) * d + e[7], 6) AS pz, u, v, round(d, 6) AS depth, u < 140 AS seen FROM p""")
def posed_pixels(t: Tables) -> DataFrame:
    """Pixels to world points through a camera's pose, and back through its inverse."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    pose = geometry.pose_of(geometry.matrix_of_quaternion(F.slice(e, 1, 4)), F.slice(e, 5, 3))
    k = geometry.intrinsics(F.lit(300.0), F.lit(310.0), F.lit(160.0), F.lit(120.0))
    u, v, mm = ((n + _c("vec_id") % m).cast("double") for n, m in ((100, 50), (80, 30), (500, 1000)))
    p = t.embeddings.select("vec_id", pose.alias("pose"), u.alias("u"), v.alias("v"), mm.alias("mm"))
    p = p.withColumn("p", geometry.unprojected(_c("u"), _c("v"), _c("mm"), k, _c("pose")))
    p = p.withColumn("uvd", geometry.projected(_c("p"), k, geometry.pose_inverse(_c("pose"))))
    at = lambda c, i, n=6: F.round(F.get(c, F.lit(i)), n) + 0.0
    seen = geometry.is_visible(_c("uvd"), F.lit(139.999999), F.lit(240.0), _c("mm") / 1000)
    return p.select("vec_id", at("p", 0).alias("px"), at("p", 1).alias("py"), at("p", 2).alias("pz"), at("uvd", 0, 4).alias("u"), at("uvd", 1, 4).alias("v"), at("uvd", 2).alias("depth"), seen.alias("seen"))


# --- streams to their end


def _event_files(t: Tables, parts: list[DataFrame], name: str):
    """Writes a part, gives the stream over what is there, and goes on with the next."""
    path = shared.scratch(t.spark, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        yield path, streams.files(t.spark, path, part.schema, per_trigger=1000)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_stream(t: Tables) -> DataFrame:
    """Two runs of one query over two halves of the events."""
    events = t.events.select("ts", "event_type", "value", "event_id")
    out = None
    for path, stream in _event_files(t, [events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")], "tumbling"):
        out = streams.run_complete(streams.tumbling(stream, "1 hour"), f"{path}-out", f"{path}-progress")
    return out.withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT, 0) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def session_stream(t: Tables) -> DataFrame:
    """Sessions that the second run's events join are merged in the state."""
    events = t.events.select("ts", "user_id", "event_id")
    out = None
    for path, stream in _event_files(t, [events.filter("event_id % 3 <> 0"), events.filter("event_id % 3 = 0")], "sessions"):
        out = streams.run_complete(streams.sessions(stream, "30 minutes"), f"{path}-out", f"{path}-progress")
    return out


@query("""WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, ts FROM events), m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR AS mark FROM events) SELECT start, count(*) AS n FROM b, m WHERE start + INTERVAL 1 HOUR <= mark GROUP BY start""")
def late_rows_dropped(t: Tables) -> DataFrame:
    """Windows under a watermark of two hours, each given out once it is closed; a second run repeats old events, which are too late to count."""
    events = t.events.select(_c("ts").cast("timestamp").alias("ts"), "event_id")
    ends = events.agg(F.max("event_id").alias("last"), F.max("ts").alias("ts")).first()
    half = ends["last"] // 2
    middle = events.filter(_c("event_id") <= half).agg(F.max("ts")).first()[0]
    old = events.filter(_c("ts") < F.lit(middle) - F.expr("INTERVAL 5 HOURS"))
    out = None
    for path, stream in _event_files(t, [events.filter(_c("event_id") <= half), events.filter(_c("event_id") > half).unionByName(old)], "late"):
        counted = stream.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
        out = counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
        streams.run_once(out, f"{path}-out", f"{path}-progress")
    return t.spark.read.schema(out.schema).parquet(f"{path}-out")


@query("""SELECT event_id, user_id FROM events""")
def deduplicated_stream(t: Tables) -> DataFrame:
    """Every event comes twice, soon after or much too late; each is kept once."""
    events = t.events.select("ts", "event_id", "user_id")
    half = events.agg(F.max("event_id")).first()[0] // 2
    first = events.filter(_c("event_id") <= half)
    parts = [first.unionByName(first), events.filter(_c("event_id") > half).unionByName(first.filter(_c("event_id") < half // 2))]
    out = None
    for path, stream in _event_files(t, parts, "dedup"):
        out = streams.deduplicated(stream, ["event_id"], "1 hour").select("event_id", "user_id")
        streams.run_once(out, f"{path}-out", f"{path}-progress")
    return t.spark.read.schema(out.schema).parquet(f"{path}-out")
