"""One-permutation MinHash with optimal densification, b-bit packing and bias correction.

Everything here is a Catalyst expression.  A text's word shingles are hashed
once; the top bits of a hash name its bin and each bin keeps its least hash.  An
empty bin borrows from the first occupied bin of its own pseudo-random probe
sequence (optimal densification), and of each bin the low-order bits are packed
into a hex string.  Two fingerprints agree in a bin by chance with probability
``2 ** -bits``; :func:`likeness` removes that share.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
WORDS = 5
#: Probes of an empty bin, in rounds; after the last it takes the first occupied bin.
PROBES = (2, 8, 64, 256)
#: Rows of an id range, and the most ranges; ranges grow beyond that many.
RANGE_ROWS = 256
MAX_RANGES = 65_536

_LOW = (1 << (64 - BIN_BITS)) - 1


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, "[ \t\n\x0b\x0c\r]+"), "")


def shingle_hashes(words: Column, k: int = WORDS) -> Column:
    """A 64-bit hash for each k-word shingle; shorter texts are one shingle, empty ones none."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        heads = F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(1)))
        # past the end get() gives null, which xxhash64 passes over
        hashes = F.transform(heads, lambda a, i: F.xxhash64(a, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(h) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, grams)


def _is_empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)


def _bins(hashes: Column) -> Column:
    """The least hash of each bin in bin order; an empty bin holds its sentinel, the largest value it could have."""
    first = -(BINS // 2)
    sentinels = F.transform(
        F.sequence(F.lit(first), F.lit(first + BINS - 1)),
        lambda j: F.shiftleft(j.cast("bigint"), 64 - BIN_BITS).bitwiseOR(F.lit(_LOW)),
    )
    return let(
        F.sort_array(F.concat(hashes, sentinels)),
        # the first of all has no predecessor: its get() is null
        lambda s: F.filter(
            s, lambda x, i: ~F.shiftright(x.bitwiseXOR(F.get(s, i - 1)), 64 - BIN_BITS).eqNullSafe(F.lit(0).cast("bigint"))
        ),
    )


def _densified(bins: Column) -> Column:
    def probe(s: Column, j: Column, start: int, stop: int) -> Column:
        seen = F.transform(
            F.sequence(F.lit(start), F.lit(stop - 1)),
            lambda t: F.get(s, F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int")),
        )
        return F.get(F.filter(seen, lambda v: ~_is_empty(v)), F.lit(0))

    def fill(s: Column) -> Column:
        edges = [0]
        for n in PROBES:
            edges.append(edges[-1] + n)
        rounds = [(a, b) for a, b in zip(edges, edges[1:])]
        return F.transform(
            s,
            lambda x, j: F.when(~_is_empty(x), x).otherwise(
                F.coalesce(*[probe(s, j, a, b) for a, b in rounds], F.get(F.filter(s, lambda v: ~_is_empty(v)), F.lit(0)))
            ),
        )

    return let(bins, fill)


def fingerprint(text: Column, k: int = WORDS) -> Column:
    """Hex digits of ``BITS`` bits a bin, in bin order; the empty string for a text without words."""
    packed = let(
        shingle_hashes(words_of(text), k),
        lambda h: F.when(
            F.size(h) > 0,
            F.lower(F.array_join(F.transform(_densified(_bins(h)), lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0")), "")),
        ).otherwise(F.lit("")),
    )
    return packed


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints: bias-corrected, 0 to 1; two empty ones are alike."""
    cells = f"(?<=\\G.{{{BITS // 4}}})"
    equal = F.zip_with(F.split(a, cells, BINS), F.split(b, cells, BINS), lambda x, y: x == y)
    share = F.size(F.filter(equal, lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    found = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(found)


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def with_next(df: DataFrame, key: str, ties: str, carried: list[str], rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the row that follows by ``key``; the first follows the last.

    The ids' approximate quantiles cut them into ranges of about
    ``rows_per_range`` rows, so no task sees more than a few ranges; the first
    row of each range is also sent to the range before it.  The driver holds two
    numbers a range, at most ``MAX_RANGES`` of them.  Rows of one key come in the
    order of ``ties``; null keys come first.
    """
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    keys = df.select(k.alias("k"))
    total = keys.count()
    if not total:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    n = max(1, min(MAX_RANGES, -(-total // rows_per_range)))
    at = [i / n for i in range(n)]
    bounds = keys.agg(F.percentile_approx("k", at, max(10_000, 4 * n)).alias("b")).first()["b"]
    bounds = sorted(set(bounds[1:]))
    side = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]

    def range_of(x: Column) -> Column:
        if not blocks:
            return F.lit(0)
        heads = _longs([b[0] for b in blocks])
        nested = F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")
        outer = F.size(F.filter(heads, lambda b: b <= x))
        inner = F.size(F.filter(F.get(nested, outer - 1), lambda b: b <= x))
        return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * F.lit(side) + inner)

    least = dict(keys.groupBy(range_of(F.col("k")).alias("r")).agg(F.min("k").alias("k")).collect())
    present = sorted(least)
    before = {r: present[i - 1] for i, r in enumerate(present)}
    size = present[-1] + 1
    own = df.withColumn("_k", k).withColumn("_r", range_of(F.col("_k")))
    is_first = F.col("_k") == F.get(_longs([least.get(r, 0) for r in range(size)]), F.col("_r"))
    copies = F.array(F.struct(F.col("_r").alias("r"), F.lit(0).alias("ahead")))
    ahead = F.struct(
        F.get(_longs([before.get(r, 0) for r in range(size)]), F.col("_r")).cast("int").alias("r"), F.lit(1).alias("ahead")
    )
    sent = own.withColumn("_to", F.explode(F.when(is_first, F.concat(copies, F.array(ahead))).otherwise(copies)))
    w = Window.partitionBy("_to.r").orderBy("_to.ahead", "_k", ties)
    out = sent.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return out.filter(F.col("_to.ahead") == 0).drop("_k", "_r", "_to")


def fingerprint_report(documents: DataFrame) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and the likeness to those and to the next document's.

    The edited text replaces the last quarter of the code points by as many (or
    all) from the start of the next document in ascending ``doc_id``.  Null text:
    empty text.  Null ``doc_id``: before all others.  Rows of one ``doc_id``
    follow each other in order of text.  One document follows itself.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(marked, "doc_id", "text", ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    edits = paired.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    both = edits.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint"
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
