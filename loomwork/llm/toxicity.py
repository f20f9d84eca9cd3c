"""Toxicity by weak supervision.

1. Voters, each toxic, clean or abstaining.  A list of insults and a list of
   insulting word starts are fixed.  The others are mined: a half of the sample
   gives a lexicon of words, lists of short and of long word starts, a count of
   several hits, and weaker lists of suspect units: two words or three starts vote toxic, and a
   document without any is voted clean.  They vote on the other half, so no vote knows a document's own label.
2. Generative label model.  A latent class with one vote of three kinds per voter
   is fitted by expectation-maximisation without labels: it estimates each
   voter's accuracy and how often it abstains on either class.  Voters that
   depend on each other given the class are found by conditional mutual
   information and joined by a spanning forest, so that correlated votes don't
   count twice.
3. A linear classifier is trained on the posterior labels by hinge loss.  Its
   features are words and word starts of all sampled texts, those that the
   posterior tells apart in either direction, scaled by their log ratio; the slope
   and offset that turn margins into probabilities are set on the sample's labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.labelled import Sparse, dual_coordinate_descent, fit_platt, frequent, gathered, held_out, sampled, sigmoid

#: The bound of the training sample, in labelled documents.
SAMPLE = 8_000
THRESHOLD = 0.7
#: Lengths of word starts, in bytes.
STARTS = (4, 5, 6, 7)
#: A unit must stand in so many sampled texts.
LEAST_DOCUMENTS = 3
#: Least standard deviations between a feature's posterior share and the overall one.
APART = 4.0
#: The cost of a sure row's loss, and the parts of the sample that margins are set on.
COST, FOLDS = 0.05, 3
#: First bytes that a unit's number tells; a word is looked up further only if some feature has them.
HEAD = 3
#: Words whose units a worker keeps.
KEPT = 200_000
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
# Insults, and starts of insulting words in four languages.
INSULTS = tuple(
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns imbecile".split()
)
INSULT_STARTS = tuple("idiot stupid moron imbec dumm blöd trott arsch crétin débil connar salaud estúp estup basura".split())

_MARKS = bytes(c for c in range(128) if not chr(c).isalpha())
_TO_SPACES = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def words(text: str) -> set[bytes]:
    """The different words: lower-cased UTF-8 between ASCII characters that aren't letters."""
    return set(text.lower().encode("utf-8", "replace").translate(_TO_SPACES).split())


def unit(name: bytes) -> int:
    """The number of a word, or of a word start, which ends in ``*``: its first HEAD bytes, a hash, and in two bits words, short and long starts."""
    kind = 0 if not name.endswith(b"*") else 1 if len(name) <= 6 else 2
    return int.from_bytes(name[:HEAD].ljust(HEAD, b" "), "big") << 32 | xxhash.xxh32_intdigest(name) & ~3 | kind


def units(word: bytes) -> list[int]:
    """Numbers of a word and its starts."""
    return [unit(word), *(unit(word[:k] + b"*") for k in STARTS if len(word) > k)]


def units_of(text: str) -> np.ndarray:
    """The different units of a text, ascending."""
    return np.array(sorted({u for w in words(text) for u in units(w)}), np.int64)


def evidence(toxic: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of units' toxic shares against the overall one."""
    p = np.clip(toxic / np.maximum(total, 1), 1e-9, 1 - 1e-6)
    return toxic * np.log(p / share) + (total - toxic) * np.log((1 - p) / (1 - share))


def votes(x: Sparse, names: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Texts by voters: two fixed lists, then those mined; for a text of one half of the sample from the other half."""

    def hits(chosen: np.ndarray) -> np.ndarray:
        return x.dot(chosen.astype(float))

    def toxic_if(found: np.ndarray) -> np.ndarray:
        return np.where(found, TOXIC, ABSTAIN)

    fixed = np.isin(names, [unit(w.encode()) for w in INSULTS])
    starts = np.isin(names, [unit(w.encode()[:k] + b"*") for w in INSULT_STARTS for k in STARTS if len(w.encode()) == k])
    half = np.arange(x.n) % 2
    mined = []
    for own in (0, 1):
        inside = (half == own).astype(float)
        toxic, total = x.turned(inside * y), x.turned(inside)
        share = min(0.99, max(0.01, float((inside * y).sum() / max(1.0, inside.sum()))))
        speaks = evidence(toxic, total, share)
        entries = (toxic >= 3) & (toxic >= 0.95 * total) & (speaks >= np.log(1 + len(names)))
        suspect = (toxic >= 3) & (toxic >= 0.6 * total) & (speaks >= 6)
        lists = [toxic_if(hits(entries & (names % 4 == kind)) > 0) for kind in range(3)]
        lists.append(toxic_if(hits(entries) > 3))
        lists += [toxic_if(hits(suspect & (names % 4 == kind)) > least) for kind, least in enumerate((1, 2, 2))]
        lists.append(np.where(hits(suspect | fixed | starts) == 0, CLEAN, ABSTAIN))
        mined.append(np.stack(lists, axis=1))
    other = np.where((half == 0)[:, None], mined[1], mined[0])
    return np.c_[toxic_if(hits(fixed) > 0), toxic_if(hits(starts) > 0), other]


@dataclass
class LabelModel:
    """Prior, and for each voter P(vote | class, vote of its parent): table[voter, class, parent's vote, vote]."""

    prior: float = 0.5
    parent: list[int] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 2, 3, 3)))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.full(len(v), np.log(self.prior) - np.log(1 - self.prior))
        for j, p in enumerate(self.parent):
            of = v[:, p] if p >= 0 else np.zeros(len(v), int)
            odds += np.log(self.table[j, 1, of, v[:, j]]) - np.log(self.table[j, 0, of, v[:, j]])
        return sigmoid(odds)

    def _maximise(self, v: np.ndarray, q: np.ndarray) -> None:
        self.table = np.empty((v.shape[1], 2, 3, 3))
        for j, p in enumerate(self.parent):
            for c, weight in enumerate((1 - q, q)):
                overall = np.bincount(v[:, j], weights=weight, minlength=3)
                # a vote for the other class is rarer than one for the own, of which there may be none
                overall = (overall + (0.5, (0.5, 0.02)[c], (0.02, 0.5)[c])) / (overall.sum() + 1.02)
                for of in range(3):
                    among = weight * (v[:, p] == of) if p >= 0 else weight
                    found = np.bincount(v[:, j], weights=among, minlength=3) + 2 * overall
                    self.table[j, c, of] = found / found.sum()
        self.table = np.clip(self.table, 1e-4, 1)

    def fit(self, v: np.ndarray, share: float, rounds: int = 40) -> LabelModel:
        """Fits the voters' tables; the classes' balance, ``share``, is given."""
        self.prior = float(np.clip(share, 0.005, 0.95))
        self.parent = [-1] * v.shape[1]
        q = sigmoid(1.5 * (v == TOXIC).sum(axis=1) - 1.5 * (v == CLEAN).sum(axis=1) - 1.0)
        for _ in range(rounds):
            self._maximise(v, q)
            q = self.posterior(v)
        self.parent = spanning_forest(dependence(v, q))
        for _ in range(rounds):
            self._maximise(v, q)
            q = self.posterior(v)
        return self


def dependence(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Conditional mutual information of each pair of voters given the class."""
    k = v.shape[1]
    out = np.zeros((k, k))
    for weight in (q, 1 - q):
        total = weight.sum() + 1e-9
        kinds = [(v == kind).astype(float) for kind in range(3)]
        for a in kinds:
            for b in kinds:
                both = np.clip((a * weight[:, None]).T @ b / total, 1e-9, 1)
                alone = np.clip(np.outer(weight @ a, weight @ b) / total**2, 1e-9, 1)
                out += total / max(1, len(v)) * both * (np.log(both) - np.log(alone))
    np.fill_diagonal(out, 0)
    return out


def spanning_forest(weight: np.ndarray, least: float = 0.005) -> list[int]:
    """A parent for each voter (-1: none): greatest links first, none under ``least``, no circles."""
    k = len(weight)
    parent, inside = [-1] * k, {0}
    while len(inside) < k:
        a, b = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda e: weight[e])
        if weight[a, b] >= least:
            parent[b] = a
        inside.add(b)
    return parent


@dataclass
class Model:
    """Weights of units, and the bias."""

    weights: dict[int, float]
    bias: float


class Scorer:
    """Scores texts with one model; of words it has seen it keeps which of their units count."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias
        self.heads = {(u >> 32).to_bytes(HEAD, "big").rstrip(b" ") for u in model.weights}
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def _known(self, word: bytes) -> tuple[int, ...]:
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[word] = found = tuple(u for u in units(word) if u in self.weights)
        return found

    def __call__(self, text: str) -> float:
        heads = self.heads
        own = [w for w in words(text) if w[:HEAD] in heads]
        get = self.kept.get
        found = {u for w, k in zip(own, map(get, own)) for u in (k if k is not None else self._known(w))}
        return self.bias + sum(map(self.weights.__getitem__, sorted(found)))


def train(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of texts' units; without rows of both classes it gives the labels' smoothed share."""
    n, total = len(labels), int(labels.sum())
    if not total or total == n:
        share = (total + 1) / (n + 2)
        return Model({}, float(np.log(share / (1 - share))))
    names = frequent(rows, LEAST_DOCUMENTS)
    x = Sparse.placed(names, rows)
    v = votes(x, names, labels.astype(float))
    q = LabelModel().fit(v, total / n).posterior(v)
    mass, held = x.turned(q), x.turned(np.ones(n))
    share = float(np.clip(q.mean(), 0.01, 0.99))
    used = np.flatnonzero(np.abs(mass - held * share) >= APART * np.sqrt(held * share * (1 - share)))
    x = x.only(used)
    del rows, v
    target = np.where(q > 0.5, 1, -1)
    sure = 0.02 + np.abs(2 * q - 1)

    def fit(part: np.ndarray) -> np.ndarray:
        """Weights and bias: units scaled by their posterior log ratio, the rows' costs by how sure their labels are."""
        own = x.part(part)
        p, c = 1 + own.turned(q[part]), 1 + own.turned(1 - q[part])
        ratio = np.log(p / p.sum()) - np.log(c / c.sum())
        w = dual_coordinate_descent(own.scaled(ratio), target[part], len(used), COST * sure[part], epochs=12)
        return np.r_[w[:-1] * ratio, w[-1]]

    margin, fold = np.zeros(n), np.arange(n) % FOLDS
    for k in range(FOLDS):
        w, other = fit(np.flatnonzero(fold != k)), np.flatnonzero(fold == k)
        margin[other] = x.part(other).dot(w[:-1]) + w[-1]
    a, c = fit_platt(margin, labels)  # on the sample's own labels, by models that haven't seen the row
    w = fit(np.arange(n))
    return Model({int(names[u]): float(a * k) for u, k in zip(used, w) if k}, float(a * w[-1] + c))


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    model = train(*gathered(sampled(documents, labels, "toxic", SAMPLE), units_of))
    pa.default_memory_pool().release_unused()  # the driver's copy of the sample
    return model


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    Null texts score as empty ones; repeated rows have a row each; a null doc_id
    stays null.  An empty table of documents gives an empty one, and labels
    without both classes give every document the same score.
    """
    model = fitted(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = sigmoid(np.array([scorer(t or "") for t in batch.column(1).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    found = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows, all columns, that score under the threshold."""
    model, at = fitted(documents, labels), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = sigmoid(np.array([scorer(t or "") for t in batch.column(at).to_pylist()], float))
            yield batch.filter(pa.array(found < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
