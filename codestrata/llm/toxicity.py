"""Toxicity by a factorization machine over hashed terms (operator 3).

Terms are the lower-case words of a text and the beginnings (4 and 5 letters) of longer ones, hashed into a table of fixed
size, every one of them; a text is the set of its terms.  Besides a weight for each term, the machine has a short vector for
each, and the products of these vectors weigh every pair of terms that occur together, such as an insult with the mention of a
group, which a sum of weights cannot.

Weights are learnt by follow-the-regularised-leader with L1 (a term stays at 0 until the evidence for it adds up), vectors by
adaptive gradient steps with L2, on a bounded sample of labelled rows (about ``per_class`` of each class, picked by a hash of
the id; each class weighs as much as it does among all labelled rows).  A part of the sample is set aside: weights alone are
trained for ``weight_epochs`` at most, then vectors with them for ``pair_epochs`` at most, and the state with the least loss on
that part is kept, so that pairs weigh nothing where they do not help on texts not trained on.

Whole texts are scored; a worker remembers the terms of words it has met.

Defined cases: null and empty texts, and texts without a known term, get the score of the bias; labels that are null,
and labels without a document, teach nothing; with a single class or no labels at all every score is the share of label
1 (0 without labels); a document with several labels counts once for each; repeated rows pass through, and equal texts get
equal scores; a score of just 0.5 is predicted toxic; a text of any length is read whole; an empty table gives an empty
result; label, language, source and id are no inputs of a score, and further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_is, sampled

_WORD = re.compile(r"[^\W_]+")
#: Slots of the table of weights and vectors.
HASHES = 1 << 20
CACHE, CACHE_CHARS = 400_000, 32


def word_terms(word: str) -> list[int]:
    parts = [word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n)]
    return [zlib.crc32(p.encode("utf-8")) & (HASHES - 1) for p in parts]


def text_words(text: str | None) -> set[str]:
    return {*_WORD.findall(text.lower())} if text else set()


def text_terms(text: str | None) -> np.ndarray:
    return np.array(sorted({t for w in text_words(text) for t in word_terms(w)}), np.int32)


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the sample of labelled rows."""

    per_class: int = 4000
    factors: int = 8
    aside: float = 0.1
    weight_epochs: int = 8
    pair_epochs: int = 20
    patience: int = 3
    #: A state is better where its loss is lower by this share.
    gain: float = 0.005
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    pair_rate: float = 0.05
    l2_factors: float = 2e-3
    spread: float = 0.01
    seed: int = 5


@dataclass
class Machine:
    """``names``: the slots that weigh something, in order, with their weights and vectors."""

    names: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    _seen: dict = field(default_factory=dict, repr=False)
    _place: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}, "_place": None}

    def raw(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        v = self.vectors[at]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (total @ total - (v * v).sum()))

    def places(self, words: set[str]) -> np.ndarray:
        """Places among ``names`` of the known terms of some words, each once, in order."""
        if self._place is None:
            self._place = np.full(HASHES, -1, np.int32)
            self._place[self.names] = np.arange(len(self.names))
        seen, known = self._seen, set()
        for word in words:
            terms = seen.get(word)
            if terms is None:
                terms = tuple(int(p) for p in self._place[word_terms(word)] if p >= 0)
                if len(word) <= CACHE_CHARS:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[word] = terms
            if terms:
                known.update(terms)
        return np.array(sorted(known), np.int64)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.places(text_words(text))), -60, 60))))


class _Trainer:
    """Weights (follow-the-regularised-leader) and vectors (adaptive steps) over the whole table, and the loss on rows set
    aside."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], share: float, settings: Settings):
        self.settings, self.rng = settings, np.random.default_rng(settings.seed)
        self.label, self.terms = np.array([y for y, _ in rows]), [t.astype(np.int64) for _, t in rows]
        ones = int(self.label.sum())
        self.weight = np.where(self.label == 1, share * len(rows) / ones, (1 - share) * len(rows) / (len(rows) - ones))
        order = self.rng.permutation(len(rows))
        n = int(settings.aside * len(rows))
        self.aside, self.used = (order[:n], order[n:]) if n else (order, order)
        self.state = {"w": np.zeros(HASHES, np.float32), "z": np.zeros(HASHES, np.float32), "n": np.zeros(HASHES, np.float32), "v": np.zeros((HASHES, settings.factors), np.float32), "b": np.array([np.log(share / (1 - share)), 1.0])}
        self.squares: np.ndarray | None = None
        self.best, self.least = self.copy(), self.loss()

    def copy(self) -> dict[str, np.ndarray]:
        return {k: x.copy() for k, x in self.state.items()}

    def raw(self, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = self.state["v"][at]
        total = v.sum(axis=0)
        return float(self.state["b"][0] + self.state["w"][at].sum() + 0.5 * (total @ total - (v * v).sum())), v, total

    def loss(self) -> float:
        raws = np.array([self.raw(self.terms[i])[0] for i in self.aside])
        return float((self.weight[self.aside] * np.logaddexp(0, np.where(self.label[self.aside] == 1, -raws, raws))).sum())

    def step(self, i: int) -> None:
        s, x, at = self.settings, self.state, self.terms[i]
        raw, v, total = self.raw(at)
        error = (1 / (1 + np.exp(-np.clip(raw, -60, 60))) - self.label[i]) * self.weight[i]
        x["b"][1] += error * error
        x["b"][0] -= 0.1 * error / np.sqrt(x["b"][1])
        if not len(at) or abs(error) < 1e-4:
            return
        squares = x["n"][at] + np.float32(error * error)
        z = x["z"][at] + np.float32(error) - (np.sqrt(squares) - np.sqrt(x["n"][at])) / s.alpha * x["w"][at]
        x["z"][at], x["n"][at] = z, squares
        x["w"][at] = np.where(np.abs(z) <= s.l1, 0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(squares)) / s.alpha))
        if self.squares is not None:
            slope = error * (total - v) + s.l2_factors * v
            self.squares[at] += slope * slope
            x["v"][at] = v - s.pair_rate * slope / np.sqrt(self.squares[at])

    def epochs(self, most: int) -> None:
        """Up to ``most`` passes, ending after ``patience`` without gain; then the best state of all so far."""
        idle = 0
        for _ in range(most):
            for i in self.rng.permutation(self.used):
                self.step(int(i))
            if (loss := self.loss()) < self.least * (1 - self.settings.gain):
                self.best, self.least, idle = self.copy(), loss, 0
            elif (idle := idle + 1) >= self.settings.patience:
                break
        self.state = {k: x.copy() for k, x in self.best.items()}

    def with_vectors(self) -> None:
        met = np.unique(np.concatenate(self.terms))
        self.state["v"][met] = self.rng.normal(0, self.settings.spread, (len(met), self.settings.factors))
        self.squares = np.ones_like(self.state["v"])


def train(rows: list[tuple[int, np.ndarray]], share: float, settings: Settings) -> Machine:
    """Fit to ``(label, terms)``, in any order; ``share`` is the share of label 1 among all labelled rows."""
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    ones = sum(y for y, _ in rows)
    share = min(max(share, 1e-6), 1 - 1e-6) if rows else 1e-6
    if not 0 < ones < len(rows):
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, settings.factors)))
    trainer = _Trainer(rows, share, settings)
    trainer.epochs(settings.weight_epochs)
    trainer.with_vectors()
    trainer.epochs(settings.pair_epochs)
    w, v = trainer.state["w"], trainer.state["v"]
    names = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
    return Machine(names, float(trainer.state["b"][0]), w[names].astype(np.float64), v[names].astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, settings: Settings) -> Machine:
    """A machine learnt from documents and labels that are joined by id; the sample of labels is what is broadcast."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    n, ones = known.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = F.when(F.col("label") == 1, settings.per_class / max(1, ones)).otherwise(settings.per_class / max(1, n - ones))
    sample = known.filter(sampled("id", share, settings.seed))
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([text_terms(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["label", "terms"])

    # Packed, so that the sample takes little room on its way and on the driver.
    got = both.mapInArrow(features, "label int, terms binary").toLocalIterator()
    return train([(r.label, np.frombuffer(r.terms, np.int32)) for r in got], ones / max(1, n), settings)


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1."""
    if score_col in docs.columns:
        raise ValueError(f"column {score_col} is there already")
    shipped, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shipped.value.score
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(t.as_py()) for t in batch.column(at)], pa.float64())], names=[*batch.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()
) -> DataFrame:
    """Learn from the labels of all folds but one and score every row: id, ``held_out``, ``score``, ``predicted``."""
    machine = fit(docs, labels.filter(~fold_is(id_col, folds, held_fold)), id_col=id_col, text_col=text_col, label_col=label_col, settings=settings)
    slim = docs.select(F.col(id_col).alias("id"), fold_is(id_col, folds, held_fold).alias("held_out"), F.col(text_col).alias("text"))
    return score(slim, machine).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
