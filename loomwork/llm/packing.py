"""Packing: optimal length buckets and token-budget batches.

The lengths' global histogram is counted in Spark; a dynamic programme over it
chooses the bucket boundaries that minimise padding, and documents fill the
batches of their bucket, each of as many as its padded lengths fit the budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.storage import keep

BUCKETS = 16
#: Padded tokens of a batch.
BUDGET = 65_536
#: Documents that one task numbers, within a bucket.
SHARD_ROWS = 16_384


def tokens_of(text: Column) -> Column:
    """White-space separated words; null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t\n\x0b\x0c\r]+"), "")).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The greatest length of each bucket, for the least total of (boundary - length), by dynamic programming.

    The cost of a bucket is monotone in the sense of the quadrangle inequality,
    so each layer is solved by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return []
    k = min(buckets, n)
    docs = np.r_[0, np.cumsum(counts)].astype(np.float64)
    mass = np.r_[0, np.cumsum(counts * lengths)].astype(np.float64)
    tops = lengths.astype(np.float64)
    best = tops * docs[1:] - mass[1:]  # one bucket for the first i + 1 lengths
    choice = np.zeros((k, n), np.int64)
    for layer in range(1, k):
        new = np.full(n, np.inf)
        stack = [(layer, n - 1, layer, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            start = np.arange(a, min(mid, b) + 1)  # where the last bucket starts
            cost = best[start - 1] + tops[mid] * (docs[mid + 1] - docs[start]) - (mass[mid + 1] - mass[start])
            at = int(cost.argmin())
            new[mid], choice[layer, mid] = cost[at], start[at]
            stack += [(lo, mid - 1, a, int(start[at])), (mid + 1, hi, int(start[at]), b)]
        best = new
    out, end = [], n - 1
    for layer in range(k - 1, -1, -1):
        out.append(int(lengths[end]))
        end = int(choice[layer, end]) - 1
    return out[::-1]


def packed(documents: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, padded_tokens, batch_id, slot.

    ``tokens`` is the documents' length, by default their words; null counts as 0.
    The histogram has a cell for each different length, and the programme is
    exact over all of them.
    A batch holds ``max(1, budget // padded_tokens)`` documents of one bucket, so
    a document longer than the budget has a batch of its own; every batch of a
    bucket but its last is full.  Empty documents are of length 0 and pad to
    their bucket's boundary.  Repeated rows are documents of their own, a null
    doc_id stays null, an empty table gives an empty one.  Rows are numbered in shards of a bucket and the
    shards' counts are summed, so no bucket meets in one task.
    """
    lengths = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce((tokens_of(F.col("text")) if tokens is None else tokens).cast("bigint"), F.lit(0).cast("bigint")).alias("n_tokens"))
    lengths = keep(lengths, "lengths")
    histogram = lengths.groupBy(F.col("n_tokens").alias("n")).count().orderBy("n").collect()
    tops = boundaries(np.array([r["n"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), buckets) or [0]
    shards = max(1, -(-sum(r["count"] for r in histogram) // SHARD_ROWS))
    bucket = F.size(F.filter(F.array(*map(F.lit, tops)), lambda t: t < F.col("n_tokens")))
    order = F.xxhash64("doc_id", "n_tokens")
    dealt = lengths.withColumns({"bucket": bucket, "padded_tokens": F.get(F.array(*[F.lit(t).cast("bigint") for t in tops]), bucket), "shard": F.pmod(order, F.lit(shards))})
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(order, "doc_id", "n_tokens"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("bucket", "shard").count()
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("rank", rank).join(offsets, ["bucket", "shard"])
    place = F.col("before") + F.col("rank") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_tokens", F.lit(1))))
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_tokens",
        F.concat_ws("-", "bucket", F.floor(place / room)).alias("batch_id"),
        F.pmod(place, room).cast("int").alias("slot"),
    )


def batches(placed: DataFrame) -> DataFrame:
    """(batch_id, bucket, doc_ids, lengths, padded_tokens, padding) of the batches of :func:`packed`: documents in order of their slots.

    ``lengths`` is the mask of the batch: so many tokens of each padded row count.
    A batch's padded tokens are at most the budget, or it holds one document.
    """
    row = F.struct("slot", "doc_id", "n_tokens")
    made = placed.groupBy("batch_id", "bucket").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first("padded_tokens").alias("width"), F.sum("n_tokens").alias("n"))
    padded = F.size("rows") * F.col("width")
    return made.select("batch_id", "bucket", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.n_tokens").alias("lengths"), padded.alias("padded_tokens"), (padded - F.col("n")).alias("padding"))


def padding(placed: DataFrame) -> DataFrame:
    """One row: documents, tokens, padding in the buckets, and padding if all documents were one bucket."""
    sums = placed.agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("padded_tokens").alias("padded"), F.max("padded_tokens").alias("top"))
    return sums.select("documents", "tokens", (F.col("padded") - F.col("tokens")).alias("padding"), (F.col("documents") * F.col("top") - F.col("tokens")).alias("padding_one_bucket"))
