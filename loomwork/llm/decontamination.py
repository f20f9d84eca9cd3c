"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts and items are normalised alike (lower case, only letters, digits and bytes
beyond ASCII, single blanks) and compared as UTF-8 bytes.  An item of m bytes
with at most e edits in a text keeps at least ``m + 1 - Q - Q * e`` of its
q-grams there (the q-gram lemma), all on diagonals within e of each other.
Bands of ``2 * (e + 1)`` diagonals that start every ``e + 1`` cover every such
run; the shared q-grams are counted in them, bands with fewer than the bound are
let go, and the others are verified by an alignment of the item inside the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.storage import keep

Q = 10
#: Edits that an item may have, as a share of its bytes.
EDITS = 0.08
#: Bytes of items that one pass over the documents holds; more items take more passes.
PASS_BYTES = 4_000_000

_BASE = 0x9E3779B97F4A7C15
#: Powers of the base, modulo 2 ** 64.
_P1, _P2, _P4 = (np.uint64(pow(_BASE, k, 1 << 64)) for k in (1, 2, 4))
#: Shared q-grams of a text that are spread over bands at once.
HITS = 2_000_000
_TABLE_BITS = 20
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACES = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_TO_SPACES).split())


def gram_hashes(data: bytes) -> np.ndarray:
    """A polynomial hash of every run of Q = 10 bytes, built by doubling."""
    one = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(one) < Q:
        return np.empty(0, np.uint64)
    two = one[:-1] * _P1 + one[1:]
    four = two[:-2] * _P2 + two[2:]
    eight = four[:-4] * _P4 + four[4:]
    return eight[:-2] * _P2 + two[8:]


def budget(m: int) -> tuple[int, int]:
    """(edits, least shared q-grams) of an item of m >= Q bytes; short items get fewer edits."""
    e = min(int(EDITS * m), (m - Q) // Q)
    return e, m + 1 - Q - Q * e


def align(item: np.ndarray, region: np.ndarray, width: int) -> tuple[int, int]:
    """(edits, end) of the item's best place in the region: it starts at one of the first ``width`` columns' diagonals.

    Row i holds, for each diagonal k of the band, the edits of the item's first
    i bytes against a part of the region that ends before column i + k.
    """
    m = len(item)
    padded = np.zeros(m + width + 1, np.int16)
    padded[: min(len(region), len(padded))] = region[: len(padded)]
    padded[len(region) :] = -1
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    far = np.int64(1 << 30)
    for i in range(m):
        kept = row + (padded[i : i + width] != item[i])
        gone = np.append(row[1:], far) + 1
        row = np.minimum(kept, gone)
        row = np.minimum.accumulate(row - steps) + steps
    best = int(row.argmin())
    return int(row[best]), min(m + best, len(region))


def started(item: bytes, text: bytes, end: int, edits: int) -> int:
    """Where the best place of an item begins that ends at ``end`` with so many edits: an alignment back from there."""
    back = text[max(0, end - len(item) - edits) : end][::-1]
    row = list(range(len(back) + 1))
    for i, x in enumerate(reversed(item), 1):
        lo, hi = max(1, i - edits), min(len(back), i + edits)
        new = [i if i <= edits else edits + 1] + [edits + 1] * len(back)
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (back[j - 1] != x), row[j] + 1, new[j - 1] + 1)
        row = new
    return end - min(range(len(row)), key=lambda j: (row[j], abs(j - len(item))))


_BUILT: dict[tuple, Items] = {}


def _rebuilt(ids: list, texts: list[bytes]) -> Items:
    """A worker's tables of a pass: tasks that follow each other in it share them."""
    key = (len(ids), hash(tuple(ids)), hash(tuple(texts)))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(ids, texts)
    return _BUILT[key]


@dataclass
class Items:
    """The items of one pass and the sorted table of their q-grams; only ids and texts travel to workers."""

    ids: list[int]
    texts: list[bytes]

    def __reduce__(self):
        return _rebuilt, (self.ids, self.texts)

    def __post_init__(self):
        self.bounds = [budget(len(t)) if len(t) >= Q else (0, 0) for t in self.texts]
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < Q]
        parts = [gram_hashes(t) for t in self.texts]
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, np.int64)
        grams = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.at = grams[order], item[order].astype(np.int32), at[order].astype(np.int32)
        self.step = np.array([e + 1 for e, _ in self.bounds], np.int64)
        self.least = np.array([t for _, t in self.bounds], np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def bands(self, text: bytes) -> list[tuple[int, int]]:
        """(item, band) of each band that holds the item's bound of shared q-grams."""
        h = gram_hashes(text)
        p = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(p):
            return []
        g = h[p]
        first, last = np.searchsorted(self.grams, g, "left"), np.searchsorted(self.grams, g, "right")
        times = last - first
        some = np.flatnonzero(times)
        p, first, times = p[some], first[some], times[some]
        if not len(p):
            return []
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        part = (np.cumsum(times) - times) // HITS  # a gram that text and item repeat has hits of the product of both
        for own in np.split(np.arange(len(p)), np.flatnonzero(np.diff(part)) + 1):
            n = times[own]
            hit = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item = self.item[hit].astype(np.int64)
            band = (np.repeat(p[own], n) - self.at[hit]) // self.step[item]
            key, count = np.unique(np.concatenate([(item << 40) + band + (1 << 38), (item << 40) + band - 1 + (1 << 38)]), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, count]), minlength=len(keys)).astype(np.int64)
        keys = keys[counts >= self.least[keys >> 40]]
        return [(int(k) >> 40, (int(k) & ((1 << 40) - 1)) - (1 << 38)) for k in keys]

    def regions(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified places in a normalised text; places of one item don't overlap."""
        found = []
        for i in self.short:
            spaced, short = b" " + text + b" ", b" " + self.texts[i] + b" "
            at = spaced.find(short)
            while at >= 0:
                found.append((i, at, at + len(self.texts[i]), 0))
                at = spaced.find(short, at + len(short) - 1)  # the blank between two places is shared
        for i, band in self.bands(text):
            item, e, step = self.texts[i], self.bounds[i][0], int(self.step[i])
            lo = band * step - e
            region = text[max(0, lo) : band * step + 2 * step + len(item) + e]
            at = region.find(item)
            if at >= 0:
                at += max(0, lo)
                found.append((i, at, at + len(item), 0))
                continue
            # a band may begin before the text: -1 stands there, as it does behind its end
            cells = np.r_[np.full(max(0, -lo), -1, np.int16), np.frombuffer(region, np.uint8)]
            edits, end = align(np.frombuffer(item, np.uint8), cells, 2 * step + 2 * e + 1)
            if edits <= e:
                found.append((i, started(item, text, lo + end, edits), lo + end, edits))
        kept: list[tuple[int, int, int, int]] = []
        for f in sorted(found, key=lambda f: (f[0], f[3], f[1])):
            if all(f[0] != k[0] or f[2] <= k[1] or f[1] >= k[2] for k in kept):
                kept.append(f)
        return kept


def passes(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[tuple[Items, bool]]:
    """The items in passes of about PASS_BYTES, and whether each is the only one.

    A pass is collected when the one before it is done with, so what the driver
    and workers hold is bounded.  An item of more bytes is a pass by itself.
    """
    marked = items.select(F.col(id_column).cast("bigint").alias("i"), F.col(text_column).alias("t"))
    total = marked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // PASS_BYTES))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(count))
    for n in range(count):
        rows = sorted(marked.filter(part == n).collect(), key=lambda r: (r["i"] is None, r["i"] or 0, r["t"] or ""))
        texts = [normalised(r["t"]) for r in rows]
        own = [(r["i"], t) for r, t in zip(rows, texts) if t]
        yield Items([i for i, _ in own], [t for _, t in own]), count == 1


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per place of an item in a document: doc_id, item_id, first_word, n_words, edits, similarity.

    Words are counted in the normalised text.  Documents without such a place
    have no row; null and empty texts have none, and empty items match nothing.
    Repeated rows of documents or items give a row each; null ids stay null.  The
    places of several passes are written one pass after the other.
    """
    out = None
    schema = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, edits int, similarity double"
    for group, only in passes(items):

        def run(batches: Iterator[pa.RecordBatch], group: Items = group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = normalised(text)
                    for i, start, end, edits in group.regions(data):
                        before, size = data.count(b" ", 0, start), len(group.texts[i])
                        n = len(data[start:end].split())
                        rows.append((doc, group.ids[i], before, n, edits, 1 - edits / size))
                cols = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"]
                )

        found = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
        found = found if only else keep(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def keep_uncontaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The input's rows, all columns, that hold no item."""
    at = documents.columns.index("text")
    for group, only in passes(items):

        def run(batches: Iterator[pa.RecordBatch], group: Items = group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not group.regions(normalised(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
        documents = documents if only else keep(documents, "clean")
    return documents
