"""Bounded samples of labelled documents, and sparse linear algebra for models trained on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose crc32 leaves this remainder are held out: no label of theirs is learned from.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def sampled(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(i, text, y): whole texts and 0/1 labels of at most ``limit`` labelled documents that aren't held out.

    ``limit`` is the documented bound: the ids with the least hashes are taken,
    so it is a random sample that depends on the ids alone.  Null labels and ids
    are passed over; of several labels for one id the largest counts, of several
    texts the least.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("i"), F.col(label).cast("int").alias("y"))
        .filter("i is not null and y is not null")
        .filter(~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(limit)
    )
    texts = documents.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def gathered(rows: DataFrame, features: Callable[[str], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of the sampled rows, made by the executors, and their labels, in order of ids; texts don't come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found, pa.list_(pa.int64())), batch.column("y")], names=["i", "x", "y"])

    table = rows.select(F.col("i").cast("bigint").alias("i"), "text", "y").mapInArrow(run, "i bigint, x array<bigint>, y int").toArrow()
    found: list[np.ndarray] = []
    for chunk in table.column("x").chunks:  # the rows stay where they are; only their order is made anew
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        found += [values[a:b] for a, b in zip(ends, ends[1:])]
    order = np.argsort(table.column("i").to_numpy(), kind="stable")
    return [found[k] for k in order], table.column("y").to_numpy()[order].astype(np.int64)


def frequent(found: list[np.ndarray], least: int, parts: int = 8) -> np.ndarray:
    """The features of ``least`` rows or more, ascending; counted in parts, so that few of all are held at a time."""
    out = []
    for part in range(parts):
        names, counts = np.unique(np.concatenate([f[f % parts == part] for f in found]), return_counts=True)
        out.append(names[counts >= least])
    return np.sort(np.concatenate(out))


class Sparse:
    """Rows of feature numbers, each once, all with the value 1; few large arrays, whose memory goes back when they do."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self._set(np.array([len(r) for r in rows], np.int64), np.concatenate(rows) if rows else np.empty(0, np.int32), width)

    def _set(self, sizes: np.ndarray, at: np.ndarray, width: int) -> Sparse:
        self.ends = np.r_[0, np.cumsum(sizes)]
        self.at = at.astype(np.int32, copy=False)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.n, self.width = len(sizes), width
        return self

    @classmethod
    def placed(cls, names: np.ndarray, rows: list[np.ndarray], step: int = 500) -> Sparse:
        """Where the numbers of each row stand among the ascending names, of those that do."""
        sizes, at = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            if not len(names):
                sizes.append(np.zeros(len(part), np.int64))
                continue
            every = np.concatenate(part)
            row = np.repeat(np.arange(len(part)), [len(r) for r in part])
            place = np.minimum(np.searchsorted(names, every), len(names) - 1)
            good = names[place] == every
            sizes.append(np.bincount(row[good], minlength=len(part)))
            at.append(place[good].astype(np.int32))
        return cls.__new__(cls)._set(np.concatenate(sizes), np.concatenate(at), len(names))

    def only(self, used: np.ndarray) -> Sparse:
        """The rows with the used features alone, numbered anew."""
        new = np.full(self.width, -1, np.int32)
        new[used] = np.arange(len(used), dtype=np.int32)
        at = new[self.at]
        good = at >= 0
        return Sparse.__new__(Sparse)._set(np.bincount(self.row[good], minlength=self.n), at[good], len(used))

    def part(self, which: np.ndarray) -> Sparse:
        """Some of the rows."""
        rows = self.rows()
        return Sparse([rows[i] for i in which], self.width)

    def scaled(self, by: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each row's features with their values ``by``."""
        values = by.astype(np.float32)[self.at]
        return [(self.at[a:b], values[a:b]) for a, b in zip(self.ends, self.ends[1:])]

    def rows(self) -> list[np.ndarray]:
        return [self.at[a:b] for a, b in zip(self.ends, self.ends[1:])]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def turned(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``v``."""
        return np.bincount(self.at, weights=v[self.row], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, c: np.ndarray, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of the L1-loss linear SVM (y in -1, 1; ``c`` the cost of each row); the last weight is the bias."""
    w = np.zeros(width + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1
            pull = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == c[i] else g
            if pull:
                worst = max(worst, abs(pull))
                old = alpha[i]
                alpha[i] = min(max(old - g / norms[i], 0.0), c[i])
                step = (alpha[i] - old) * y[i]
                w[at] += step * v
                w[-1] += step
        if worst < 0.01:
            break
    return w


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b): Newton steps with halving on smoothed targets; a stays positive."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    centre, spread = float(margin.mean()), float(margin.std()) or 1.0
    x = np.stack([(margin - centre) / spread, np.ones(len(margin))], axis=1)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-3 * v[0] ** 2)

    v = np.array([1.0, np.log(pos / neg)])
    now = loss(v)
    for _ in range(100):
        p = sigmoid(x @ v)
        g = x.T @ (p - target) + np.array([2e-3 * v[0], 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-6])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(v - size * step) > now:
            size /= 2
        new = loss(v - size * step)
        if new >= now - 1e-9:
            break
        v, now = v - size * step, new
    a = max(1e-6, v[0] / spread)
    return float(a), float(v[1] - a * centre)
