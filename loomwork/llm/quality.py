"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear support vector machine.

The n-grams are of words (1, letters lowered) and of token shapes (1 to 3),
in which a token's letters, digits and marks are folded to their kinds; shapes
carry over to words no sample has shown.  Indicators are scaled by the classes' log-count ratios and a hinge-loss model is fitted by
dual coordinate descent; its margins are turned into probabilities on folds that
the model for them has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.labelled import Sparse, dual_coordinate_descent, fit_platt, frequent, gathered, held_out, sampled, sigmoid

#: The bound of the training sample, in labelled documents.
SAMPLE = 4_000
THRESHOLD = 0.5
#: A feature must stand in so many sampled documents.
LEAST_DOCUMENTS = 3

def _kinds() -> bytes:
    table = bytearray(range(256))
    for c in range(256):
        table[c] = ord("0") if 48 <= c < 58 else ord("A") if 65 <= c < 91 else ord("a") if 97 <= c < 123 or c >= 128 else c
    return bytes(table)


_KIND = _kinds()


def token_shapes(data: bytes) -> list[bytes]:
    """Tokens of UTF-8 text as kinds: a run of letters is one a or A, of digits one 0, of one mark at most two of it."""
    kinds = np.frombuffer(data.translate(_KIND), np.uint8)
    if not len(kinds):
        return []
    same = np.r_[False, kinds[1:] == kinds[:-1]]
    plain = (kinds == ord("a")) | (kinds == ord("A")) | (kinds == ord("0"))
    third = same & np.r_[False, same[:-1]]
    return kinds[~(same & plain | third)].tobytes().split()


class Hashes(dict):
    """The 64-bit hash of a token or shape; those met first are kept."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, shape: bytes) -> int:
        found = xxhash.xxh64_intdigest(shape, self.seed)
        if len(self) < KEPT:
            self[shape] = found
        return found


#: Shapes, and words, whose hashes a worker keeps.
KEPT = 200_000
_SHAPES, _WORDS = Hashes(0), Hashes(1)
#: An n-gram is a number in this odd base, modulo 2 ** 64; the top bit is cleared, and the lowest tells words from shapes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOP, _EVEN, _ODD = np.uint64((1 << 63) - 1), np.uint64((1 << 63) - 2), np.uint64(1)
#: The share of words' log-count ratios beside those of shapes, of which there are far fewer.
WORDS_SHARE = 0.15


def _share(part: int, whole: int) -> int:
    return int(8 * part / whole) if whole else 9


def features(text: str) -> np.ndarray:
    """The n-gram indicators of a whole text as numbers, ascending; the empty text has one that says so.

    Numbers from 0 are hashes of 1- to 3-grams of shapes and of words, bytes A-Z
    lowered.  Numbers below 0 are indicators
    of the whole: how often a token repeats the last one, how many tokens, pairs
    and lines differ, and how long text and tokens are, each in a few steps.
    """
    data = text.encode("utf-8", "replace")
    tokens = data.split()
    n = len(tokens)
    if not n:
        return np.array([-1], np.int64)
    kinds = np.fromiter(map(_SHAPES.__getitem__, token_shapes(data)), np.uint64, n)
    grams = [kinds]
    if n > 1:
        grams.append((kinds[:-1] + np.uint64(1)) * _BASE + kinds[1:])
    if n > 2:
        grams.append((grams[1][:-1] + np.uint64(1)) * _BASE + kinds[2:])
    words = np.fromiter(map(_WORDS.__getitem__, data.lower().split()), np.uint64, n)
    again = sum(map(bytes.__eq__, tokens, tokens[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = _share(len(set(tokens)), n)
    whole = (
        _share(again, n),
        distinct,
        _share(len(np.unique(grams[1])), n - 1) if n > 1 else 9,
        _share(len(lines) - len(set(lines)), len(lines)),
        min(n.bit_length(), 40),
        distinct + 10 * min(n.bit_length(), 40),
        min(24, len(data) // n),
    )
    return np.r_[[-1000 * (i + 1) - v for i, v in enumerate(whole)][::-1], np.unique(np.concatenate([np.concatenate(grams) & _EVEN, words & _TOP | _ODD])).view(np.int64)]


@dataclass
class Model:
    """Weights of features, in ascending order of their numbers, and the bias."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function of a text: the probability's exponent."""
        top = max(0, len(self.numbers) - 1)

        def score(text: str) -> float:
            found = features(text)
            if not len(self.numbers):
                return self.bias
            at = np.minimum(np.searchsorted(self.numbers, found), top)
            return self.bias + float(self.weights[at[self.numbers[at] == found]].sum())

        return score


def train(found: list[np.ndarray], labels: np.ndarray, cost: float = 0.1, folds: int = 4) -> Model:
    """A model of texts' :func:`features`; without rows of both classes it gives the labels' smoothed share."""
    n, pos = len(labels), int(labels.sum())
    if not pos or pos == n:
        share = (pos + 1) / (n + 2)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    names = frequent(found, LEAST_DOCUMENTS)
    rows = Sparse.placed(names, found)
    share = np.where((names >= 0) & (names % 2 == 1), WORDS_SHARE, 1.0)

    def fit(part: np.ndarray) -> np.ndarray:
        """Weights of the plain indicators: log-count ratios times the machine's weights."""
        y = labels[part]
        x = rows.part(part)
        p, q = 1 + x.turned(y.astype(float)), 1 + x.turned((1 - y).astype(float))
        ratio = share * (np.log(p / p.sum()) - np.log(q / q.sum()))
        weigh = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        w = dual_coordinate_descent(x.scaled(ratio), 2 * y - 1, len(names), cost * weigh)
        return np.r_[w[:-1] * ratio, w[-1]]

    fold = np.arange(n) % folds
    margin = np.zeros(n)
    for k in range(folds):
        own, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w = fit(own)
        margin[other] = rows.part(other).dot(w[:-1]) + w[-1]
    a, b = fit_platt(margin, labels)
    w = fit(np.arange(n))
    used = w[:-1] != 0
    return Model(names[used], a * w[:-1][used], float(a * w[-1] + b))


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    model = train(*gathered(sampled(documents, labels, "quality", SAMPLE), features))
    pa.default_memory_pool().release_unused()  # the driver's copy of the sample
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each whole text: the probability of label 1; null text as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = [score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(np.array(found, float)))], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null texts score as empty ones; repeated rows have a row each; a null doc_id
    stays null.  An empty table of documents gives an empty one, and labels
    without both classes give every document the same score.
    """
    found = scored(documents, fitted(documents, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows, all columns, that the classifier doesn't reject."""
    model, at = fitted(documents, labels), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = sigmoid(np.array([score(t or "") for t in batch.column(at).to_pylist()], float))
            yield batch.filter(pa.array(found >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
