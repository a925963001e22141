"""Language identification by sparse multinomial logistic regression (operator 5).

Features are hashed character n-grams (1 to 4 letters) of the lower-case words of a text, each word between marks of its
ends.  A feature's value is its share of the text's n-grams times its inverse document frequency; the document
frequencies come from all documents that may be learnt from.  The weights are trained by follow-the-regularised-leader
with L1 and L2 penalties (most end at zero) on a bounded sample of labelled rows: about ``per_language`` of each
language, picked by a hash of the id.  On a part of that sample set aside, one temperature is fitted by likelihood, so
that ``score`` is a calibrated probability.

Whole texts are scored; their n-grams are made with array operations, for many words at a time.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; a text whose n-grams are all unknown gets
the language with the largest bias; rows without a language or with a null id teach nothing; without any labelled row
everything is ``und``; repeated rows pass through, and equal texts get equal results; of languages equally likely, the first
by name is given; a text of any length is read whole; an empty table gives an empty result; the language column is read while
learning only, and further columns never, whatever they are called (where whole rows are kept, they are passed through).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold_is, numbered, sampled
from .threads import release_memory

UNKNOWN = "und"
BITS = 17
DIMENSIONS = 1 << BITS
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose n-grams are made at a time.
WORDS_AT_ONCE = 20_000
LONGEST = 4
_STEPS = np.random.Generator(np.random.PCG64(41)).integers(1, 2**62, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_START = ord("<")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> Iterator[np.ndarray]:
    """Hashed n-grams of the words, each between its end marks, with repeats; in pieces for long texts."""
    for at in range(0, len(words), WORDS_AT_ONCE):
        marked = f"<{'><'.join(words[at : at + WORDS_AT_ONCE])}>"
        letters = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.cumsum(letters == _START)
        total, out = np.zeros(len(letters), np.uint64), []
        for n in range(1, LONGEST + 1):
            m = len(letters) - n + 1
            if m < 1:
                break
            with np.errstate(over="ignore"):
                total = total[:m] + letters[n - 1 :] * _STEPS[n - 1]
                mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            # A window over two words has the start mark of the second inside.
            out.append((mixed[word[n - 1 :] == word[:m]] >> np.uint64(64 - BITS)).astype(np.int64))
        yield np.concatenate(out)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a text, and how often each occurs."""
    parts = list(grams_of(words_of(text)))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the sample of labelled rows that the weights are fitted to.  Every language with labelled
    rows is learnt; more than ``max_languages`` of them (the weights take room for each) are an error."""

    per_language: int = 500
    max_languages: int = 200
    calibration_share: float = 0.2
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    scale: float = 10.0
    seed: int = 11


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # dimensions x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    scale: float

    def __post_init__(self):
        self.table = (self.weights * self.idf[:, None]).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        # A run may be of signs like fractions only, which are no letters.
        letter = any(map(str.isalpha, words)) or any(c.isalpha() for c in text or "")
        if not letter or not self.languages:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for grams in grams_of(words):
            total += self.table.take(grams, axis=0).sum(axis=0, dtype=np.float64)
            n += len(grams)
        logits = (self.bias + self.scale * total / max(1, n)) / self.temperature
        odds = np.exp(logits - logits.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return odds / odds.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, settings: Settings) -> LanguageModel:
    """Fit to ``(language, n-grams, counts)``; the order of ``rows`` does not matter."""
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), idf, 1.0, settings.scale)
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(rows))
    aside = {int(i) for i in order[: int(settings.calibration_share * len(rows))]}
    data = [(languages.index(lang), grams, counts / counts.sum() * idf[grams] * settings.scale) for lang, grams, counts in rows]
    k = len(languages)
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(zi) <= settings.l1, 0.0, w)

    for _ in range(settings.epochs):
        for i in rng.permutation(len(data)):
            if int(i) in aside:
                continue
            label, grams, values = data[i]
            at, x = np.append(grams, DIMENSIONS), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1.0
            gradient = x[:, None] * error
            squares = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(squares) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = squares
    w = weights(np.arange(DIMENSIONS + 1))
    held = [data[i] for i in sorted(aside)] or data
    logits = np.array([x @ w[g] + w[-1] for _, g, x in held])
    truth = np.array([y for y, _, _ in held])

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean())

    grid = np.geomspace(0.5, 20, 121)
    temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return LanguageModel(languages, w[:-1].astype(np.float32), w[-1], idf, temperature, settings.scale)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, over all rows of a one-column table, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, there = np.zeros(DIMENSIONS, np.int64), 0, np.zeros(DIMENSIONS, bool)
        for batch in batches:
            for text in batch.column(0):
                parts = list(grams_of(words_of(text.as_py())))
                for grams in parts:
                    there[grams] = True
                # Each n-gram of the text once, without going through all that there are.
                for grams in parts:
                    once = grams[there[grams]]
                    there[grams] = False
                    total[once] = total[once] + 1
                rows += 1
        some = np.flatnonzero(total)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([rows, *total[some].tolist()], pa.int64())], names=["gram", "n"])

    # At most one sum for each dimension reaches the driver.
    sums = texts.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMENSIONS)
    at = sums["gram"].to_numpy()
    out[at[at >= 0]] = sums["n"].to_numpy()[at >= 0]
    return out, int(sums["n"].to_numpy()[at < 0].sum())


def fit(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> LanguageModel:
    """A model learnt from the rows where ``learnable`` holds and text and language are not null."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learnable.alias("ok")).filter("ok AND text IS NOT NULL AND lang IS NOT NULL")
    counts, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + counts)) + 1
    sizes = rows.groupBy("lang").count()
    if (k := sizes.count()) > settings.max_languages:
        raise ValueError(f"{k} languages; at most {settings.max_languages} are learnt")
    shares = sizes.select("lang", (settings.per_language / F.col("count")).alias("share"))
    # Broadcast: a row for each language learnt.
    sample = rows.join(F.broadcast(shares), "lang").filter(sampled("id", F.col("share"), settings.seed)).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), *(pa.array([f[k].astype(np.int32).tobytes() for f in found], pa.binary()) for k in (0, 1))],
                names=["lang", "grams", "counts"],
            )

    # Packed, so that the sample takes little room on its way and on the driver.
    got = sample.mapInArrow(features, "lang string, grams binary, counts binary").toLocalIterator()
    return train([(r.lang, np.frombuffer(r.grams, np.int32).astype(np.int64), np.frombuffer(r.counts, np.int32).astype(np.float64)) for r in got], idf, settings)


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with two more columns: predicted language and calibrated probability."""
    for c in (pred_col, score_col):
        if c in docs.columns:
            raise ValueError(f"column {c} is there already")
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = shipped.value.predict
        for batch in batches:
            out = [guess(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=[*batch.schema.names, pred_col, score_col])
        release_memory()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))


def keep_sure(docs: DataFrame, model: LanguageModel, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns under any names, that are in a known language with a score of ``least``."""
    rows = numbered(docs)
    judged = predict(rows, model, text_col=rows.columns[docs.columns.index(text_col)])
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*rows.columns).toDF(*docs.columns)


def identify(docs: DataFrame, *, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Learn from all folds but one and predict every row: id, ``held_out``, ``lang_pred``, ``score``."""
    learnable = F.col(id_col).isNotNull() & ~fold_is(id_col, folds, held_fold)
    model = fit(docs, learnable, id_col=id_col, text_col=text_col, lang_col=lang_col, settings=settings)
    slim = docs.select(F.col(id_col).alias("id"), fold_is(id_col, folds, held_fold).alias("held_out"), F.col(text_col).alias("text"))
    return predict(slim, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
