"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint is a row of bytes.  Two fingerprints that differ in at most
``radius`` bits differ in at most that many bytes, so the pair shares the bytes
of all other positions.  The index posts each distinct fingerprint under
triples of positional bytes; for 8 bytes and a radius of 4 a pair shares at
least 4 bytes, and 20 triples (a Turan system) suffice to meet every set of 4
positions.  Within one posting list the shared positional bytes of a pair are
tallied, pairs under the guaranteed minimum are let go, and the rest is
verified by counting differing bits.

A posting list is searched breadth-first: a member is compared only with those
that no component of the list has reached, so a list of near copies costs one
sweep and gives a tree of links instead of all pairs, and its components are
those that all its links would give.  Lists over ``LIST_ROWS`` members are
passed on to a second level where one more byte is added to the key, in all
ways that a pair with the guaranteed minimum can share it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm import likeness
from loomwork.llm.components import components
from loomwork.llm.shingles import shingle_hashes
from loomwork.llm.storage import forget, keep

#: Members of a posting list that are compared in one go.
LIST_ROWS = 16_384
#: Rows of an Arrow batch that index rows are built in.
OUT_ROWS = 40_000


def turan_triples(parts: Iterable[Iterable[int]] = ((0, 1, 2), (3, 4, 5), (6, 7))) -> list[tuple[int, ...]]:
    """Triples of positions in three parts, so that any 4 positions hold one of them."""
    a, b, c = (tuple(p) for p in parts)
    found = [t for p in (a, b, c) for t in combinations(p, 3)]
    for two, one in ((a, b), (b, c), (c, a)):
        found += [tuple(sorted((*t, x))) for t in combinations(two, 2) for x in one]
    return found


@dataclass(frozen=True)
class Design:
    """What fingerprints are made of and which of them link.

    ``words`` shingle words; ``lanes`` 64-bit lanes; ``triples`` positions of the
    index keys; ``radius`` most differing bits over the first ``checked`` lanes;
    ``least`` shared positional bytes over those lanes.
    """

    words: int
    lanes: int
    checked: int
    radius: int
    least: int
    triples: tuple[tuple[int, ...], ...]

    def __post_init__(self):
        if self.least < 4:  # long lists are searched by a triple and one more byte
            raise ValueError("a pair must share 4 bytes or more")


#: 64 bits, 4-word shingles, links at 4 bits or fewer: complete.
CONTRACT = Design(words=4, lanes=1, checked=1, radius=4, least=4, triples=tuple(turan_triples()))


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The lanes' fingerprints: a bit is set where over half of the hashes have it; zero without hashes."""
    out = np.zeros(lanes, np.uint64)
    n = len(hashes)
    if not n:
        return out
    mixed = hashes
    for lane in range(lanes):
        if lane:  # further lanes hash the hash
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * lane + 1)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        set_bits = np.zeros(64, np.int64)
        for at in range(0, n, 65_536):
            part = np.ascontiguousarray(mixed[at : at + 65_536])
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits += bits.sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(documents: DataFrame, designs: list[Design]) -> DataFrame:
    """(doc_id, f0, f1, ...): the designs' fingerprint lanes of each whole text as longs; null text as the empty one."""
    lanes = sum(d.lanes for d in designs)
    names = [f"f{i}" for i in range(lanes)]

    def of(text: bytes) -> np.ndarray:
        found = []
        for d in designs:
            found.append(simhash(shingle_hashes(text, d.words), d.lanes))
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([of(t or b"") for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, lanes).view(np.int64)
            cols = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    schema = ", ".join(["doc_id bigint", *(f"{n} bigint" for n in names)])
    typed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return typed.mapInArrow(run, schema)


def _bytes(lanes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), -1)


def _index(reps: DataFrame, design: Design) -> DataFrame:
    """Posts each distinct fingerprint under its keys, triple and bytes: (key, rep, f0, ...)."""
    names = [f"f{i}" for i in range(design.lanes)]
    shown = names[: design.checked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, OUT_ROWS // len(design.triples))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rep = batch.column("rep").to_numpy(zero_copy_only=False)
                lanes = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
                by = _bytes(lanes).astype(np.int64)
                keys = [(i << 24) | (by[:, a] << 16) | (by[:, b] << 8) | by[:, c] for i, (a, b, c) in enumerate(design.triples)]
                times = len(design.triples)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.tile(rep, times)), *(pa.array(np.tile(lanes[:, i], times)) for i in range(len(shown)))],
                    names=["key", "rep", *shown],
                )

    schema = ", ".join(["key bigint", "rep bigint", *(f"{n} bigint" for n in shown)])
    return reps.select("rep", *names).mapInArrow(run, schema)


def _deeper(lists: DataFrame, design: Design) -> DataFrame:
    """Index rows of lists that were too long, each under every key with one more of the checked bytes."""
    shown = [f"f{i}" for i in range(design.checked)]
    others = [[p for p in range(8 * design.checked) if p not in t] for t in design.triples]
    free = F.get(F.from_json(F.lit(json.dumps(others)), "array<array<int>>"), F.shiftright("key", 24).cast("int"))

    def deeper_key(p: Column) -> Column:
        lane = F.get(F.array(*shown), F.floor(p / 8).cast("int"))
        byte = F.call_function("shiftrightunsigned", lane, (8 * (p % 8)).cast("int")).bitwiseAND(F.lit(255))
        return F.xxhash64("key", p, byte)

    return lists.select(F.explode(F.transform(free, deeper_key)).alias("key"), "rep", *shown)


def tree_of_links(rep: np.ndarray, lanes: np.ndarray, design: Design) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a posting list's members as all of its links do, found breadth-first."""
    order = np.argsort(rep, kind="stable")
    rep, lanes = rep[order], lanes[order].view(np.uint64)
    by = _bytes(lanes)
    left = np.arange(len(rep))
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = left
            if design.least:  # the count filter
                near = left[(by[left] == by[at]).sum(axis=1) >= design.least]
            if len(near):
                off = np.bitwise_count(lanes[near] ^ lanes[at]).sum(axis=1, dtype=np.int64)
                near = near[off <= design.radius]
            if len(near):
                a.append(np.full(len(near), rep[at]))
                b.append(rep[near])
                left = left[~np.isin(left, near, assume_unique=True)]
                queue.extend(near.tolist())
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _matches(index: DataFrame, design: Design, last: bool, most: int = LIST_ROWS) -> DataFrame:
    """(key, a, b, ...): links where ``key`` is null, and the rows of lists that are passed on."""
    shown = [f"f{i}" for i in range(design.checked)]
    names = ["key", "a", "b", *shown]

    def out(key, a, b, lanes=None) -> pa.RecordBatch:
        n = len(a)
        blank = pa.nulls(n, pa.int64())
        more = [pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(len(shown))] if lanes is not None else [blank] * len(shown)
        return pa.RecordBatch.from_arrays([blank if key is None else pa.array(key), pa.array(a), blank if b is None else pa.array(b), *more], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the list whose rows may go on in the next batch
        rows, long_key = 0, None

        def links(key, rep, lanes) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(key)]
            big = np.flatnonzero(ends - starts > 1)
            a, b = [], []
            for i in big:
                s, e = starts[i], ends[i]
                x, y = tree_of_links(rep[s:e], lanes[s:e], design)
                a.append(x)
                b.append(y)
            if a and sum(map(len, a)):
                yield out(None, np.concatenate(a), np.concatenate(b))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            lanes = np.stack(cols, axis=1)
            while len(key):
                if long_key is not None:  # more of a list that is passed on
                    n = int(np.searchsorted(key, long_key, side="right"))
                    if n:
                        yield out(key[:n], rep[:n], None, lanes[:n])
                    if n < len(key):
                        long_key = None
                    key, rep, lanes = key[n:], rep[n:], lanes[n:]
                    continue
                if held:
                    key, rep, lanes = (np.concatenate([h, x]) for h, x in zip(held, (key, rep, lanes)))
                    held = []
                cut = int(np.searchsorted(key, key[-1], side="left"))
                yield from links(key[:cut], rep[:cut], lanes[:cut]) if cut else ()
                held, rows = [key[cut:], rep[cut:], lanes[cut:]], len(key) - cut
                if rows > most and not last:
                    yield out(held[0], held[1], None, held[2])
                    long_key, held = held[0][0], []
                break
        if held:
            yield from links(*held)

    schema = ", ".join(["key bigint", "a bigint", "b bigint", *(f"{n} bigint" for n in shown)])
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def links(reps: DataFrame, design: Design) -> DataFrame:
    """(a, b) with the connectivity of all links between distinct fingerprints (rep, f0, ...)."""
    first = keep(_matches(_index(reps, design), design, last=False), "links")
    found = first.filter("key is null").select("a", "b")
    long_lists = first.filter("key is not null").withColumnRenamed("a", "rep")
    if long_lists.isEmpty():
        return found
    second = _matches(_deeper(long_lists, design), design, last=True)
    return found.unionByName(keep(second, "links").select("a", "b"))


#: Stands for a null doc_id among ids.
LOWEST = -(1 << 63)


def grouped(prints: DataFrame, design: Design) -> DataFrame:
    """(doc_id, f0, ..., component_id) for fingerprint rows (doc_id, f0, ...)."""
    names = [f"f{i}" for i in range(design.lanes)]
    ids = F.coalesce("doc_id", F.lit(LOWEST))
    reps = keep(prints.groupBy(*names).agg(F.min(ids).alias("rep")), "simhash-classes")
    edges = links(reps, design)
    # a doc_id on rows of different texts is one node: those rows' classes meet
    shared = prints.groupBy(ids.alias("i")).agg(F.min_by(F.struct(*names), F.struct(*names)).alias("x"), F.max_by(F.struct(*names), F.struct(*names)).alias("y"))
    shared = shared.filter("x <> y").select("i")
    if not shared.isEmpty():
        own = prints.select(ids.alias("i"), *names).join(shared, "i").join(reps, names)
        edges = edges.unionByName(own.select(F.col("i").alias("a"), F.col("rep").alias("b")))
    labels = components(edges)
    classes = reps.join(labels, reps["rep"] == labels["node"], "left").select(*names, F.coalesce("component", "rep").alias("c"))
    return prints.join(classes, names).select("doc_id", *names, F.when(F.col("c") != LOWEST, F.col("c")).alias("component_id"))


def near_duplicates(documents: DataFrame, design: Design = CONTRACT) -> DataFrame:
    """(doc_id, f0, ..., component_id) per row: the least doc_id that links reach, itself included.

    Equal fingerprints link; so do the zero fingerprints of texts without words.
    A null doc_id is an id below all others and stays null as a component.  Rows
    of one doc_id are one node, whatever their texts.
    """
    return grouped(keep(fingerprints(documents, [design]), "simhash"), design)


def fingerprint_components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, by :data:`CONTRACT`."""
    found = near_duplicates(documents, CONTRACT)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def _prints_and_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, f0, s0, s1): the contract's fingerprint and a 128-bit digest of the set of shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            f0 = np.array([simhash(shingle_hashes(t, CONTRACT.words))[0] for t in texts], np.uint64).view(np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(likeness.shingle_set(t).tobytes()) for t in texts)
            sets = np.frombuffer(digests, np.int64).reshape(-1, 2)
            cols = (f0, np.ascontiguousarray(sets[:, 0]), np.ascontiguousarray(sets[:, 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=["doc_id", "f0", "s0", "s1"])

    typed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return typed.mapInArrow(run, "doc_id bigint, f0 bigint, s0 bigint, s1 bigint")


def first_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows whose doc_id is the least of its group; of rows that share it, the least text stays.

    Groups are the components of all links of :data:`CONTRACT` and all pairs of
    texts whose sets of 5-word shingles have a likeness of 0.8 or more.  A null
    doc_id is an id below all others, a null text has no shingles and an empty
    table gives an empty one; columns of any name are passed through.
    """
    prints = keep(_prints_and_sets(documents), "simhash")
    ids = F.coalesce("doc_id", F.lit(LOWEST))
    edges, classes = [], []
    for names in (["f0"], ["s0", "s1"]):
        reps = keep(prints.groupBy(*names).agg(F.min(ids).alias("rep")), "simhash-classes")
        classes.append(reps)
        own = prints.select(ids.alias("a"), *names).join(reps, names).select("a", F.col("rep").alias("b"))
        edges.append(own.filter("a <> b"))
        if names == ["f0"]:
            edges.append(links(reps, CONTRACT))
    known = keep(reduce(DataFrame.unionByName, edges), "simhash-links")
    # one text of each set; a doc_id on rows of different texts is one node, so any of its texts may link it
    texts = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("rep"), "text").join(reps.select("rep").distinct(), "rep", "left_semi")
    labels = components(known.unionByName(likeness.links(texts, known)))
    later = labels.filter("node <> component").select("node")
    counted = prints.groupBy("doc_id").agg(F.count("*").alias("n"))
    stay = keep(counted.join(later, ids == F.col("node"), "left_anti"), "simhash-stay")
    forget(prints, *classes, known)
    own = fresh("id", documents)
    ids = stay.select(F.col("doc_id").alias(own), "n")
    kept = lambda some: documents.join(some, documents["doc_id"].eqNullSafe(some[own]), "left_semi")
    again = ids.filter("n > 1")
    if again.isEmpty():
        return kept(ids)
    # null texts come first; a partial least of each task goes through the shuffle, not all rows of an id
    first = F.struct(documents["text"].isNotNull(), documents["text"])
    one = kept(again).groupBy(documents["doc_id"].alias(own)).agg(F.min_by(F.struct(*(documents[f"`{c}`"] for c in documents.columns)), first).alias("row"))
    return kept(ids.filter("n = 1")).unionByName(one.select("row.*"))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
