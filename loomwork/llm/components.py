"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.storage import forget, keep

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours, and itself, to the least node among them and it."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if large:
        linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edge table (a, b); the component is its least node.

    Every round is one large-star and one small-star step, written to the shared
    folder; the rounds end when a round changes nothing (its row count and hash
    sum stay).  Nodes without an edge aren't in the result.
    """
    now = keep(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        after = keep(_star(_star(now, large=True), large=False), "edges")
        forget(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    labelled = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labelled.unionByName(labelled.select(F.col("component").alias("node"), "component").distinct())
