"""Benchmark decontamination: rare n-gram seeds, then local alignment (operator 9).

1.  One pass over all documents counts the words of the benchmark.  An n-gram of a test item is a seed where the product
    of its words' rates is at most ``max_rate``; each item keeps at least its ``min_seeds`` rarest n-grams.  Rates of words
    rather than counts of n-grams decide, so an item that has leaked thousands of times does not lose its seeds.
2.  A second pass finds the seeds in every document.  Hits of one item that lie within its length of each other make up
    one place; around each place the item is aligned to the document by Smith-Waterman over words (match, mismatch and
    gap scores are parameters), so edited, cut or reworded copies keep most of their score.
3.  A document leaks an item where the best alignment has at least ``threshold`` of the score of the whole item, or where
    a stretch of ``long_match`` words of the item matches it (for items of which only a part was copied).

Words are runs of letters and digits in lower case.  The items go to the workers in blocks of at most ``block_bytes`` of
text, each block in two passes of its own, so what is broadcast is bounded however large the benchmark is.

Defined cases: null and empty texts leak nothing; an item without a word or with a null text matches nothing, and one of
fewer than n words has all its words as its only n-gram and is found where a document consists of just these; equal
documents and equal items are reported each for itself; empty tables give an empty result; only the id and text columns
of both tables are read, and null ids are reported like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .folds import numbered
from .shingles import ngram_hashes, word_hashes

#: ASCII bytes other than letters and digits become spaces.
_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Rules:
    n: int = 3
    max_rate: float = 1e-8
    min_seeds: int = 6
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5
    long_match: int = 30


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words of a text."""
    return word_hashes((text or "").lower().encode("utf-8").translate(_WORDS))


def align(item: np.ndarray, part: np.ndarray, rules: Rules) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, first and last position in ``part`` (linear gaps)."""
    m = len(part)
    steps = np.arange(m + 1, dtype=np.int64) * -rules.gap
    place = np.arange(m + 1, dtype=np.int64)
    row = np.zeros(m + 1, np.int64)
    begin = place.copy()  # where the alignment that ends in a cell starts
    best = (0, 0, -1)
    for word in item:
        pair = np.where(part == word, rules.match, rules.mismatch)
        over = np.zeros(m + 1, np.int64)
        start = place.copy()
        diagonal = row[:-1] + pair
        up = row + rules.gap
        np.maximum(over[1:], diagonal, out=over[1:])
        take = (over[1:] == diagonal) & (diagonal > 0)
        start[1:][take] = begin[:-1][take]
        take = up > over
        over[take], start[take] = up[take], begin[take]
        # Gaps along the row: the best of all cells to the left less their distance.
        slope = over + steps
        reach = np.maximum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == reach, place, 0))
        row = reach - steps
        begin = np.where(row > 0, start[source], place)
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(begin[at]), at - 1)
    return best


class Seeds:
    """The seeds of one block of items, as flat arrays."""

    def __init__(self, items: list[tuple[object, str | None]], rates, rules: Rules):
        self.rules = rules
        self.ids = [i for i, _ in items]
        self.words = [plain_words(t) for _, t in items]
        grams, owner, place = [], [], []
        for k, words in enumerate(self.words):
            if not len(words):
                continue
            hashes = ngram_hashes(words, rules.n)
            logs = np.log10(rates(words))
            n = len(words) - len(hashes) + 1
            rate = np.array([logs[i : i + n].sum() for i in range(len(hashes))])
            keep = rate <= np.log10(rules.max_rate)
            keep[np.argsort(rate, kind="stable")[: rules.min_seeds]] = True
            at = np.flatnonzero(keep)
            grams.append(hashes[at])
            owner.append(np.full(len(at), k))
            place.append(at)
        self.grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams = self.grams[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, int)
        self.place = np.concatenate(place)[order] if place else np.empty(0, int)

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """Items that a text leaks: number, share of the item's own score, first and last word."""
        if not text or not len(self.grams):
            return []
        words = plain_words(text)
        grams = ngram_hashes(words, self.rules.n)
        first = np.searchsorted(self.grams, grams)
        hit = np.flatnonzero(self.grams[np.minimum(first, len(self.grams) - 1)] == grams)
        if not len(hit):
            return []
        first, last = first[hit], np.searchsorted(self.grams, grams[hit], side="right")
        size = last - first
        at = np.repeat(hit, size)
        seed = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owner, start = self.owner[seed], at - self.place[seed]
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        out = []
        for k in np.unique(owner):
            starts, item = start[owner == k], self.words[k]
            span, full = len(item), self.rules.match * len(item)
            best = (0, 0, -1)
            cuts = np.flatnonzero(np.diff(starts) > span) + 1
            for group in np.split(starts, cuts):
                lo = max(0, int(group[0]) - span // 2 - 2)
                hi = min(len(words), int(group[-1]) + span + span // 2 + 2)
                score, a, b = align(item, words[lo:hi], self.rules)
                if score > best[0]:
                    best = (score, lo + a, lo + b)
                if score == full:
                    break
            if best[0] >= min(self.rules.threshold * full, self.rules.match * self.rules.long_match):
                out.append((int(k), best[0] / full, best[1], best[2]))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _word_rates(texts: DataFrame, words: np.ndarray):
    """Rates of ``words`` (sorted hashes) over all texts, as a function of hashes; at most as many sums as words are
    fetched, plus one."""
    shipped = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shipped.value, 0
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = plain_words(text.as_py())
                total += len(found)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                counts += np.bincount(at[known[at] == found], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([total, *counts[some].tolist()], pa.int64())], names=["word", "n"])

    sums = dict(texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    total = max(1, sums.pop(-1, 0))
    counts = np.zeros(len(words))
    for k, n in sums.items():
        counts[k] = n
    return lambda hashes: (counts[np.searchsorted(words, hashes)] + 0.5) / total


def _each_block(docs: DataFrame, benchmark: DataFrame, *, text_col: str, item_id_col: str, item_text_col: str, rules: Rules, block_bytes: int):
    """A broadcast of seeds for each block of the benchmark."""
    for items in _blocks(benchmark, item_id_col, item_text_col, block_bytes):
        words = np.unique(np.concatenate([plain_words(t) for _, t in items]))
        if len(words):
            yield docs.sparkSession.sparkContext.broadcast(Seeds(items, _word_rates(docs.select(text_col), words), rules))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rules: Rules = Rules(),
    block_bytes: int = 16_000_000,
) -> DataFrame:
    """One row per document and item that it leaks: both ids, ``score`` (share of the item's own score, 0 to 1), and the
    ``first_word`` and ``last_word`` of the place with the best alignment."""
    spark = docs.sparkSession
    shared_dir(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item_kind)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item {item_kind.simpleString()}, score double, first_word int, last_word int"

    def finder(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = shipped.value
            for batch in batches:
                found = [(i, *x) for i, t in enumerate(batch.column(1)) for x in seeds.leaks(t.as_py())]
                if found:
                    row, item, score, first, last = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([seeds.ids[k] for k in item], arrow_item), pa.array(score), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                        names=["id", "item", "score", "first_word", "last_word"],
                    )

        return run

    out = None
    blocks = _each_block(docs, benchmark, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, rules=rules, block_bytes=block_bytes)
    for shipped in blocks:
        part = slim.mapInArrow(finder(shipped), schema)
        if out is not None:  # only with more than one block
            part = part.checkpoint()
            shipped.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    item_name = item_id_col if item_id_col != id_col else f"item_{item_id_col}"
    return out.withColumnsRenamed({"id": id_col, "item": item_name})


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rules: Rules = Rules(), block_bytes: int = 16_000_000
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text leaks no item.  No join: each pass keeps or drops whole
    rows."""
    at, rows = docs.columns.index(text_col), numbered(docs)

    def keeper(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shipped.value.leaks(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return run

    for shipped in _each_block(docs, benchmark, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, rules=rules, block_bytes=block_bytes):
        rows = rows.mapInArrow(keeper(shipped), rows.schema)
    return rows.toDF(*docs.columns)
