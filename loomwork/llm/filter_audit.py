"""Filter interaction audit: what five text filters remove in every order that they can be applied in.

Five bits per document say which filters it fails.  Only the counts of equal
masks are unpivoted against the 120 orders of five steps; a running bit-or over
an order's earlier steps tells what is gone already, conditional sums give a
step's counts, and a total over a filter's rows in all orders its Shapley count.

A: under 200 words; B: under half of the words are distinct; C: over 3 % of the
code points are ``A-Z``; D: holds one of ``#$%&*|``; E: an equal text has a
smaller doc_id, kept or not.  Words stand between ASCII white space and keep
their case.

A null text counts as empty, a null language as the part ``''``, and a null
doc_id is smaller than all others and has no label.  Rows that repeat a doc_id
are documents of their own; equal texts of one id don't fail E for each other.
A doc_id with several labels has those that any of its rows gives.  An empty
table has no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
MARKS = "#$%&*|"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))


def _bit(fails: Column, letter: str) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def failures(text: Column) -> Column:
    """The bits of the filters that look at one text: A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return (
        _bit(n < MIN_WORDS, "A")
        + _bit(100 * different < DISTINCT_PERCENT * n, "B")
        + _bit(100 * capitals > CAPITAL_PERCENT * F.char_length(text), "C")
        + _bit(F.translate(text, MARKS, "") != text, "D")
    )


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters that they fail.

    Texts are replaced by a digest in the scan.  Rows are first counted by doc_id
    and then by digest, both with partial sums, so a text that a third of all
    documents share is some rows per partition of the step before, not a group in
    a task.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask")
    )
    given = labels.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    labelled = rows.join(given, "doc_id", "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = labelled.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id")).alias("least"), F.min_by("n", F.struct("doc_id")).alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    kept = by_text.withColumn("firsts", F.when(F.col("least") == first, F.col("n_least")).otherwise(F.lit(0)))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")),
        F.struct((F.col("mask") + F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")),
    )
    cells = kept.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    among = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return cells.groupBy("part", "mask").agg(among("good").alias("good"), among("toxic").alias("toxic"), F.sum("n").alias("n"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, with what the step keeps, removes and would have removed."""
    orders = F.explode(F.array(*map(F.lit, ORDERS)))
    long = mask_counts(documents, labels).withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.expr("substring(filter_order, step, 1)")
    long = long.withColumn("filter", letter).withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumn("fails", failed != 0).withColumn("gone", F.coalesce(F.bit_or(failed).over(before), F.lit(0)) != 0)
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    fails, gone = F.col("fails"), F.col("gone")
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


#: The same report in SQL, over the registered tables ``documents`` and ``labels``, one comparison per document, order and step.
AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
f AS (SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd, first_id < w.doc_id AS fe FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, good, toxic, concat(CASE WHEN fa THEN 'A' END, CASE WHEN fb THEN 'B' END, CASE WHEN fc THEN 'C' END, CASE WHEN fd THEN 'D' END, CASE WHEN fe THEN 'E' END) AS failed, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT g.*, filter_order, step::INTEGER AS step, filter_order[step] AS filter, contains(failed, filter_order[step]) AS fails,
 step > 1 AND failed <> '' AND regexp_matches(filter_order[1:step - 1], '[' || failed || '-]') AS gone FROM g, o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = filter), 0)::BIGINT AS unique_fails,
 coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""
