"""Log-probabilities of whole documents under a gated recurrent language model with class-factored output (operator 8).

Counting.  Words of all training documents are counted exactly (one partial sum per task, then a shuffle by word hash).
Words with at least ``head_share`` of all tokens, of which there are at most 1 / ``head_share``, go to every worker with
their counts; counts of rarer words stay distributed and are joined to the documents that use such words.

Model.  Outputs are the ``vocabulary`` most frequent words, the end mark, and tails: every other word falls into a tail by
its last two bytes.  Outputs are dealt into classes, those of words of about equal mass of root frequency, those of tails of
``tails_in_class``.  A token has P(class | state) P(output | class, state), and in a tail also (c + 0.1) / (mass of the
tail), 0.1 of each tail's mass being for words never seen.  The state is that of a gated recurrent network over embeddings
of outputs.  Output biases start at the counts, so the model starts as good as the unigram base and training only adds
context.

Training.  Every training document is trained on once.  Documents are split into ``rounds`` and each round's into shards of
about ``shard_tokens`` tokens, both by a hash of id and text and never by where rows happen to lie.  In a round, each shard
starts from the same network and optimizer state and runs truncated back-propagation through time over its documents, in
order of their ids (numpy, Adam, state carried from window to window and forgotten where a document ends); then networks
and optimizer states are averaged by tokens.  So neither partitioning nor the number of tasks changes a result by more than
the rounding of sums.

Scoring.  Documents are dealt to streams that advance together in windows; the state of a window's end starts the next one,
and a stream's next document starts afresh, so that every document is scored to its end, however long, and apart from all
others.

Texts are tokenised twice: to count, and to write output numbers and sums (Parquet in the shared folder, removed at the
program's end), from which training and scoring read.

Defined cases: a null or empty text is one end mark; without training documents all scores are those of the base (0, for
a single unseen outcome); repeated rows and null ids pass through (null ids are trained on never: they have no fold; rows
equal in id and text train in one shard); equal texts get equal scores up to rounding; texts of any length are read, trained
on and scored whole; an empty table gives an empty result; only the id and text columns are read, whatever others are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import own_folder, shared_dir
from .folds import fold_is
from .shingles import _SPACE, PIECE, split_words
from .threads import one_thread

#: Stands for the end of a document among word hashes.
END = np.uint64(0)
TAILS = 96
LN10 = float(np.log(10))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 2000
    head_share: float = 1e-6
    classes: int = 40
    tails_in_class: int = 16
    embedding: int = 16
    hidden: int = 24
    rounds: int = 4
    shard_tokens: int = 1_000_000
    #: Streams that train together; fewer where a shard would have under ``least_updates`` updates.
    streams: int = 256
    least_streams: int = 16
    least_updates: int = 200
    steps: int = 16
    rate: float = 0.01
    damping: float = 1e-5
    slots: int = 8
    #: What is scored together: streams, and tokens held at a time (or one longer document).
    score_streams: int = 512
    score_tokens: int = 4_000_000
    window: int = 32
    seed: int = 3


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some of the texts at a time: place of the first, hashes of words with A-Z in lower case and of end marks, the tail
    of each, and the place where each text's tokens begin (and the end of all)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    cuts = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PIECE, side="right")) - 1)
        raw, begins = _LOWER[data[cuts[at] : cuts[stop]]], cuts[at : stop + 1] - cuts[at]
        words, last, before, sizes = [], [], [], np.zeros(stop - at, np.int64)
        for lo, hi in _pieces(raw):
            w, first, end = split_words(raw[lo:hi], begins[:-1] - lo)
            sizes += np.diff(np.searchsorted(first + lo, begins))
            words.append(w)
            last.append(raw[end - 1 + lo])
            before.append(np.where(end - first > 1, raw[end - 2 + lo], 32))
        w = np.concatenate(words) if words else np.empty(0, np.uint64)
        tails = (np.concatenate(last).astype(np.int64) * 31 + np.concatenate(before).astype(np.int64) * 7) % TAILS if words else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        yield at, np.insert(w, ends, END), np.insert(tails, ends, 0), np.concatenate([[0], ends + np.arange(1, len(sizes) + 1)])
        at = stop


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end at white space."""
    at = 0
    while at < len(raw):
        stop = at + PIECE
        while stop < len(raw) and not len(space := np.flatnonzero(_SPACE[raw[stop : stop + PIECE]])):
            stop += PIECE
        stop = min(stop + int(space[0]) if stop < len(raw) else stop, len(raw))
        yield at, stop
        at = stop


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (hash), ``tail`` and ``n`` for all tokens of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tails, size = [], [], 0

        def flush() -> pa.RecordBatch:
            all_, first, n = np.unique(np.concatenate(words), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(all_.view(np.int64)), pa.array(np.concatenate(tails)[first].astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

        for batch in batches:
            for _, w, t, _ in tokens(batch.column(0)):
                words.append(w)
                tails.append(t.astype(np.int16))
                size += len(w)
                if size > 6_000_000:
                    yield flush()
                    words, tails, size = [], [], 0
        if words:
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, tail int, n long").groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


class Vocabulary:
    """Counts of frequent words, classes of outputs, and masses of tails."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tails: np.ndarray, mass: np.ndarray, kinds: np.ndarray, n_tokens: int, n_words: int, settings: Settings):
        """``words, counts, tails`` of the frequent ones; ``mass`` and ``kinds`` per tail (sums over all words)."""
        order = np.argsort(words)
        self.words, self.counts, tails = words[order], counts[order], tails[order]
        self.n_tokens, self.n_words = n_tokens, n_words
        top = np.lexsort((self.words, -self.counts))
        end = np.flatnonzero(self.words[top] == END)
        top = np.concatenate([top[end], np.delete(top, end)])[: settings.vocabulary + 1]
        top = top[np.lexsort((self.words[top], -self.counts[top]))]
        roots = np.sqrt(self.counts[top].astype(np.float64))
        share = np.cumsum(roots) / max(1.0, roots.sum())
        _, label = np.unique(np.minimum((share * settings.classes - 1e-9).astype(int), settings.classes - 1), return_inverse=True)
        #: Per frequent word: its output, or -1 for one in a tail.
        self.place = np.full(len(self.words), -1, np.int32)
        self.place[top] = np.arange(len(top))
        self.n_top = len(top)
        self.mass = mass + 0.1 * kinds - np.bincount(tails[top], self.counts[top] + 0.1, TAILS) + 0.1
        own = int(label.max()) + 1 if len(label) else 0
        #: Class of each output (each class is a range of outputs), and the mass of each.
        self.label = np.concatenate([label, own + np.arange(TAILS) // settings.tails_in_class]).astype(np.int32)
        self.n_classes = int(self.label[-1]) + 1
        self.starts = np.searchsorted(self.label, np.arange(self.n_classes + 1))
        self.masses = np.concatenate([self.counts[top] + 0.1, self.mass])
        self.end = int(self.place[np.flatnonzero(self.words == END)[0]]) if len(end) else self.n_top
        self._slots: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_slots": None}

    def _hashed(self) -> np.ndarray:
        """A table of open addresses: places of words at the first free slots from their low bits on, or -1."""
        size = 1 << max(4, (2 * len(self.words)).bit_length())
        slots = np.full(size, -1, np.int32)
        left, step = np.arange(len(self.words), dtype=np.int32), 0
        while len(left):
            at = ((self.words[left] + np.uint64(step)) & np.uint64(size - 1)).astype(np.int64)
            free = slots[at] < 0
            slots[at[free]] = left[free]  # of several, the last stays
            left, step = left[slots[at] != left], step + 1
        return slots

    def look_up(self, words: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or -1."""
        if self._slots is None:
            self._slots = self._hashed()
        out, left, asked, step = np.full(len(words), -1, np.int32), None, words, 0
        while len(asked):
            at = self._slots[((asked + np.uint64(step)) & np.uint64(len(self._slots) - 1)).astype(np.int64)]
            taken = at >= 0
            hit = taken & (self.words[np.maximum(at, 0)] == asked) if len(self.words) else taken
            if left is None:
                out[hit] = at[hit]
                left = np.flatnonzero(taken & ~hit)
            else:
                out[left[hit]] = at[hit]
                left = left[taken & ~hit]
            asked, step = words[left], step + 1
        return out

    def outputs(self, words: np.ndarray, tails: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Outputs of tokens.  ``at``: from ``look_up``."""
        at = self.look_up(words) if at is None else at
        place = np.where(at >= 0, self.place[at], -1) if len(self.place) else at
        return np.where(place >= 0, place, self.n_top + tails).astype(np.int32)


def deal(sizes: np.ndarray, streams: int) -> list[list[int]]:
    """Numbers of documents by stream: the longest first, each to the stream with the least to do so far."""
    heap = [(0, k) for k in range(max(1, min(streams, len(sizes))))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heap[0]
        heapq.heapreplace(heap, (load + int(sizes[i]), k))
        out[k].append(i)
    return sorted(out, key=lambda own: -int(sizes[own].sum()))


class Network:
    """Parameters and optimizer state are flat vectors; ``p`` has views of the former by name."""

    def __init__(self, vocabulary: Vocabulary, settings: Settings):
        self.vocabulary, self.settings = vocabulary, settings
        v, e, h = vocabulary, settings.embedding, settings.hidden
        n = len(v.label)
        self.shapes = {"embed": (n, e), "wx": (e, 3 * h), "b": (3 * h,), "u": (h, 3 * h), "wc": (h, v.n_classes), "bc": (v.n_classes,), "ww": (n, h), "bw": (n,)}
        self.flat = np.zeros(sum(int(np.prod(x)) for x in self.shapes.values()), np.float32)
        self.first, self.second, self.updates = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        rng, p = np.random.default_rng(settings.seed), self.views(self.flat)
        for name, scale in (("embed", 0.3), ("wx", e**-0.5), ("u", h**-0.5), ("wc", 0.02), ("ww", 0.02)):
            p[name][:] = rng.normal(0, scale, p[name].shape)
        of_class = np.bincount(v.label, v.masses, v.n_classes)
        p["bc"][:], p["bw"][:] = np.log(of_class / of_class.sum()), np.log(v.masses / of_class[v.label])
        self.p = p

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name], at = flat[at : at + size].reshape(shape), at + size
        return out

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "p"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.p = self.views(self.flat)

    def copy(self) -> Network:
        other = Network.__new__(Network)
        other.__setstate__(self.__getstate__() | {k: getattr(self, k).copy() for k in ("flat", "first", "second")})
        return other

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, and what its gradient needs: the recurrent part, both gates, the candidate."""
        k = self.settings.hidden
        a = h @ self.p["u"]
        gates = x[:, : 2 * k] + a[:, : 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new = gates[:, :k] * a[:, 2 * k :]
        new += x[:, 2 * k :]
        np.tanh(new, out=new)
        out = h - new
        out *= gates[:, k:]
        out += new
        return out, a, gates, new

    @staticmethod
    def _normed(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-softmax at one column of each row, and the sums of exponentials that replace the logits in ``x``.  Logits of a
        bounded state rarely need their maximum taken off."""
        if x.size and x.max() > 60:
            x -= x.max(axis=1, keepdims=True)
        picked = x[rows, at]
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], np.float32)
        return picked - np.log(total), total

    def output(self, states: np.ndarray, ids: np.ndarray, g: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each output; with ``g``, also the gradients of the negative sum: those of the output
        layer are put there, and those of the states returned."""
        p, v, rows, down = self.p, self.vocabulary, np.arange(len(ids)), None
        labels = v.label[ids]
        order = np.argsort(labels.astype(np.int16), kind="stable")
        cuts = np.searchsorted(labels[order], np.arange(v.n_classes + 1))
        states, ids, labels = states[order], ids[order], labels[order]
        x = states @ p["wc"]
        x += p["bc"]
        logs, total = self._normed(x, labels, rows)
        if g is not None:
            x /= total[:, None]
            x[rows, labels] -= 1
            g["wc"][:], g["bc"][:], down = states.T @ x, x.sum(axis=0), x @ p["wc"].T
            g["ww"][:], g["bw"][:] = 0, 0
        for k in range(v.n_classes):
            i, j, lo, hi = cuts[k], cuts[k + 1], v.starts[k], v.starts[k + 1]
            if i == j or hi - lo < 2:
                continue
            x = states[i:j] @ p["ww"][lo:hi].T
            x += p["bw"][lo:hi]
            part, total = self._normed(x, ids[i:j] - lo, rows[: j - i])
            logs[i:j] += part
            if g is not None:
                x /= total[:, None]
                x[rows[: j - i], ids[i:j] - lo] -= 1
                g["ww"][lo:hi], g["bw"][lo:hi] = x.T @ states[i:j], x.sum(axis=0)
                down[i:j] += x @ p["ww"][lo:hi]
        back = np.empty_like(order)
        back[order] = rows
        return logs[back], None if down is None else down[back]

    def windows(self, flat: np.ndarray, begins: np.ndarray, loads: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each window of streams, which lie in ``flat`` from ``begins`` on (first an end mark, then ``loads`` tokens; the
        longest stream first): tokens given and wanted, which of them there are, and where the wanted ones lie."""
        for begin in range(0, int(loads[0]) if len(loads) else 0, steps):
            live = int(np.searchsorted(-loads, -begin, side="left"))
            time = begin + np.arange(min(steps, int(loads[0]) - begin))[:, None]
            at = np.minimum(begins[:live] + time, len(flat) - 2)
            yield flat[at], flat[at + 1], time < loads[:live], at + 1

    def score(self, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Sums of natural log-probabilities of documents that lie in ``flat`` from each of ``begins`` (and up to the last)."""
        s, end = self.settings, self.vocabulary.end
        sizes = np.diff(begins)
        if not len(sizes):
            return np.zeros(0)
        streams = deal(sizes, s.score_streams)
        loads = np.array([int(sizes[own].sum()) for own in streams])
        packed, places = np.full(int(loads.sum()) + len(streams), end, np.int32), np.zeros(len(sizes), np.int64)
        at, firsts = 0, []
        for own in streams:
            firsts.append(at)
            at += 1
            for i in own:
                packed[at : at + sizes[i]], places[i] = flat[begins[i] : begins[i + 1]], at
                at += int(sizes[i])
        table = self.p["embed"] @ self.p["wx"] + self.p["b"]
        logs, h = np.zeros(len(packed)), np.zeros((len(streams), s.hidden), np.float32)
        for given, wanted, there, at in self.windows(packed, np.array(firsts), loads, s.window):
            live = given.shape[1]
            x, fresh, states, h = table[given], (given != end).astype(np.float32)[:, :, None], np.empty((*given.shape, s.hidden), np.float32), h[:live]
            for t in range(len(given)):  # where a document starts, the last one's state is forgotten
                h = states[t] = self.step(x[t], h * fresh[t])[0]
            if there.all():
                logs[at] = self.output(states.reshape(-1, s.hidden), wanted.ravel())[0].reshape(at.shape)
            else:
                logs[at[there]] = self.output(states[there], wanted[there])[0]
        order = np.argsort(places)
        out = np.zeros(len(sizes))
        ends = np.concatenate([[0], np.cumsum(logs)])
        out[order] = (ends[places + sizes] - ends[places])[order]
        return out

    def gradient(self, given: np.ndarray, wanted: np.ndarray, there: np.ndarray, h: np.ndarray, g: dict[str, np.ndarray]) -> tuple[float, int, np.ndarray]:
        """Of one window from state ``h``: the negative log-likelihood, its number of tokens, and the last state; the gradients
        of the former go to ``g``."""
        p, k, (steps, live) = self.p, self.settings.hidden, given.shape
        fresh = (given != self.vocabulary.end).astype(np.float32)[:, :, None]
        ids = given.ravel()
        embedded = p["embed"][ids]
        x = (embedded @ p["wx"] + p["b"]).reshape(steps, live, 3 * k)
        states, kept = np.empty((steps, live, k), np.float32), []
        for t in range(steps):
            before = h * fresh[t]
            h, a, gates, new = self.step(x[t], before)
            states[t] = h
            kept.append((before, a, gates, new))
        if there.all():
            logs, down = self.output(states.reshape(-1, k), wanted.ravel(), g)
            down = down.reshape(steps, live, k)
        else:
            logs, part = self.output(states[there], wanted[there], g)
            down = np.zeros((steps, live, k), np.float32)
            down[there] = part
        dx, da, du, dh = np.empty((steps, live, 3 * k), np.float32), np.empty((live, 3 * k), np.float32), np.zeros_like(p["u"]), np.zeros((live, k), np.float32)
        back = np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            before, a, gates, new = kept[t]
            dh += down[t]
            d, dn = dx[t], dx[t, :, 2 * k :]
            np.multiply(dh, 1 - gates[:, k:], out=dn)
            dn *= 1 - new * new
            np.multiply(dn, a[:, 2 * k :], out=d[:, :k])
            np.multiply(dh, before - new, out=d[:, k : 2 * k])
            d[:, : 2 * k] *= gates * (1 - gates)
            da[:, : 2 * k] = d[:, : 2 * k]
            np.multiply(dn, gates[:, :k], out=da[:, 2 * k :])
            du += before.T @ da
            dh *= gates[:, k:]
            dh += da @ back
            dh *= fresh[t]
        dx = dx.reshape(-1, 3 * k)
        g["u"][:], g["b"][:], g["wx"][:] = du, dx.sum(axis=0), embedded.T @ dx
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        g["embed"][:] = 0
        g["embed"][ids[first]] = np.add.reduceat((dx @ p["wx"].T)[order], first, axis=0)
        return -float(logs.sum()), len(logs), h

    def update(self, gradient: np.ndarray, n: int) -> None:
        """Adam on the mean over ``n`` tokens, of norm 1 at most.  ``gradient`` is used up."""
        s = self.settings
        norm = float(np.sqrt(gradient @ gradient)) / n
        gradient *= np.float32(min(1.0, 1.0 / max(norm, 1e-12)) / n)
        self.updates += 1
        self.first *= 0.9
        self.first += np.float32(0.1) * gradient
        gradient *= gradient
        gradient *= np.float32(0.001)
        self.second *= 0.999
        self.second += gradient
        root = np.sqrt(self.second)
        root += np.float32(s.damping)
        np.divide(self.first, root, out=root)
        root *= np.float32(s.rate * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates))
        self.flat -= root

    def train(self, stream: np.ndarray) -> int:
        """Truncated back-propagation over tokens in which documents end with the end mark, cut into equal streams."""
        s, n = self.settings, len(stream)
        if not n:
            return 0
        width = min(s.streams, max(s.least_streams, n // (s.steps * s.least_updates)))
        length = -(-n // max(1, min(width, n // (2 * s.steps))))
        begins = np.arange(0, n, length)
        flat = np.concatenate([[self.vocabulary.end], stream])
        gradient, h = np.zeros_like(self.flat), np.zeros((len(begins), s.hidden), np.float32)
        g = self.views(gradient)
        for given, wanted, there, _ in self.windows(flat, begins, np.minimum(length, n - begins), s.steps):
            _, count, h = self.gradient(given, wanted, there, h[: given.shape[1]], g)
            self.update(gradient, count)
        return n


def _encode(docs: DataFrame, shipped, schema: str) -> DataFrame:
    """What training and scoring read, by document: outputs of its tokens as 16-bit numbers, sums over its frequent words (how
    many, of log10(count + 0.1), and of the shares in tails), and its rarer words with their uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shipped.value
        log_count, log_mass = np.log10(v.counts + 0.1), np.log10(v.mass)
        for batch in batches:
            for place, words, tails, begins in tokens(batch.column("text")):
                size, found = np.diff(begins), v.look_up(words)
                seen, ids, first = found >= 0, v.outputs(words, tails, found), begins[:-1]
                logs = np.where(seen, log_count[found], 0.0) if len(v.counts) else np.zeros(len(words))
                in_tail = np.where(ids >= v.n_top, logs - log_mass[np.maximum(ids - v.n_top, 0)], 0.0)
                # Rarer words of each document, once, with their uses.
                unseen = np.flatnonzero(~seen)
                own, rare = np.repeat(np.arange(len(size)), size)[unseen], words[unseen]
                order = np.lexsort((rare, own))
                own, rare = own[order], rare[order]
                new = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (own[1:] != own[:-1]))) if len(rare) else np.empty(0, np.int64)
                lists = pa.array(np.searchsorted(own[new], np.arange(len(size) + 1)).astype(np.int32))
                packed = pa.py_buffer(ids.astype(np.uint16).tobytes())
                out = {k: batch.column(k).slice(place, len(size)) for k in ("id", "held_out", "shard")} | {
                    "n_tokens": pa.array(size, pa.int64()),
                    "known": pa.array(np.add.reduceat(seen, first, dtype=np.int64), pa.int64()),
                    "base": pa.array(np.add.reduceat(logs, first), pa.float64()),
                    "in_tail": pa.array(np.add.reduceat(in_tail, first), pa.float64()),
                    "outputs": pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * begins).astype(np.int32).tobytes()), packed]),
                    "words": pa.ListArray.from_arrays(lists, pa.array(rare[new].view(np.int64))),
                    "times": pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(new, len(rare))).astype(np.int32))),
                    "round": batch.column("round").slice(place, len(size)),
                }
                yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(run, schema)


def _trained(shards: DataFrame, net: Network) -> Network:
    """``net`` after training on each shard of ``shard, id, outputs``, apart from the others, and averaging by tokens."""
    spark, settings = shards.sparkSession, net.settings
    shipped = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        start, total, weight, updates = shipped.value, None, 0, 0

        def streams() -> Iterator[np.ndarray]:
            """The documents of each shard, in pieces where rows equal in id and text make it very large."""
            shard, held, size = None, [], 0
            for batch in batches:
                for k, outputs in zip(batch.column("shard").to_pylist(), batch.column("outputs"), strict=True):
                    if held and (k != shard or size > 4 * settings.shard_tokens):
                        yield np.concatenate(held)
                        held, size = [], 0
                    shard = k
                    held.append(np.frombuffer(outputs.as_buffer(), np.uint16).astype(np.int32))
                    size += len(held[-1])
            if held:
                yield np.concatenate(held)

        for stream in streams():
            local = start.copy()
            n = local.train(stream)
            part = np.concatenate([local.flat, local.first, local.second]).astype(np.float64) * n
            total = part if total is None else total + part
            weight, updates = weight + n, max(updates, local.updates)
        if weight:
            task = TaskContext.get().partitionId()
            yield _state(task % settings.slots, task, weight, updates, total)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for slot, weight, updates, state in zip(*(batch.column(k).to_pylist() for k in ("slot", "weight", "updates", "state")), strict=True):
                own = sums.setdefault(slot, [0, 0, 0.0])
                own[0] += weight
                own[1] = max(own[1], updates)
                own[2] = own[2] + np.frombuffer(state, np.float32).astype(np.float64) * weight
        for slot, (weight, updates, total) in sums.items():
            yield _state(slot, 0, weight, updates, total)

    schema = "slot int, part int, weight long, updates int, state binary"
    states = shards.mapInArrow(run, schema)
    means = states.repartition(settings.slots, "slot").sortWithinPartitions("slot", "part").mapInArrow(average, schema).collect()
    shipped.unpersist()
    if means:
        weight = sum(r.weight for r in means)
        mean = sum(np.frombuffer(r.state, np.float32).astype(np.float64) * (r.weight / weight) for r in sorted(means, key=lambda r: r.slot))
        net = net.copy()
        for x, y in zip((net.flat, net.first, net.second), np.split(mean, 3), strict=True):
            x[:] = y
        net.updates = max(r.updates for r in means)
    return net


def _state(slot: int, part: int, weight: int, updates: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"slot": pa.array([slot], pa.int32()), "part": pa.array([part], pa.int32()), "weight": pa.array([weight], pa.int64()), "updates": pa.array([updates], pa.int32()),
         "state": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())}
    )


def fit(docs: DataFrame, learnable: Column, held: Column, *, id_col: str, text_col: str, settings: Settings) -> tuple[Network, DataFrame, DataFrame]:
    """The trained network, the table of all counts (``word, tail, n``), and the encoded documents."""
    if settings.vocabulary + TAILS >= 1 << 16:
        raise ValueError("outputs are 16-bit numbers")
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), learnable.alias("learnable"), F.col(text_col).alias("text"))
    counts = count_words(rows.filter("learnable"), "text").checkpoint()
    # One row for each tail reaches the driver, and 1 / head_share words at most.
    tails = {r["tail"]: (r["n"], r["kinds"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("n").alias("kinds")).collect()}
    mass, kinds = (np.array([tails.get(t, (0, 0))[i] for t in range(TAILS)], np.float64) for i in (0, 1))
    n = int(mass.sum())
    head = counts.filter((F.col("n") >= settings.head_share * n) | (F.col("word") == int(END))).toPandas()
    words, n_head, tail = head["word"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), head["tail"].to_numpy(np.int64)
    net = Network(Vocabulary(words, n_head, tail, mass, kinds, n, int(kinds.sum()), settings), settings)

    shards = max(1, -(-n // (settings.rounds * settings.shard_tokens)))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(settings.rounds * shards))
    rows = rows.select(
        "id", "held_out", F.when(F.col("learnable"), place % settings.rounds).otherwise(-1).cast("int").alias("round"), (place / settings.rounds).cast("int").alias("shard"), "text"
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, shard int, n_tokens long, known long, base double, in_tail double, outputs binary, words array<long>, times array<int>, round int"
    folder = own_folder(spark, "lm")
    _encode(rows, spark.sparkContext.broadcast(net.vocabulary), schema).write.partitionBy("round").parquet(folder)
    encoded = spark.read.schema(schema).parquet(folder)
    tasks = min(shards, max(64, 4 * spark.sparkContext.defaultParallelism))
    for k in range(settings.rounds if n else 0):
        own = encoded.filter(F.col("round") == k).select("shard", "id", "outputs")
        net = _trained(own.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "id", "outputs"), net)
    return net, counts, encoded


def score_documents(docs: DataFrame, *, folds: int = 10, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Learn from all folds but one, score every row: id, ``held_out, n_tokens, n_known, train_tokens, base_score``
    (unigrams with 0.1 added to each count) and ``score`` (the model), both log10 of the whole text's probability."""
    held = fold_is(id_col, folds, held_fold)
    net, counts, encoded = fit(docs, F.col(id_col).isNotNull() & ~held, held, id_col=id_col, text_col=text_col, settings=settings)
    n, kinds = net.vocabulary.n_tokens, net.vocabulary.n_words
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        net = shipped.value
        for batch in batches:
            sizes, at = batch.column("n_tokens").to_numpy(), 0
            while at < len(sizes):
                ends = np.cumsum(sizes[at:])
                some = max(1, int(np.searchsorted(ends, net.settings.score_tokens, side="right")))
                part = batch.slice(at, some)
                ids = np.frombuffer(b"".join(part.column("outputs").to_pylist()), np.uint16).astype(np.int32)
                model = net.score(ids, np.concatenate([[0], ends[:some]])) / LN10 + part.column("in_tail").to_numpy()
                yield pa.RecordBatch.from_pydict({k: part.column(k) for k in ("id", "held_out", "n_tokens", "known", "base", "words", "times")} | {"model": pa.array(model, pa.float64())})
                at += some

    kind = encoded.schema["id"].dataType.simpleString()
    scored = encoded.drop("round", "shard").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, known long, base double, words array<long>, times array<int>, model double")
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    # A document travels as one row with its sums and a row for each rare word; the first has a key of its own, with 0 uses.
    items = scored.select(
        "row",
        F.explode_outer(F.expr("concat(array(named_struct('w', xxhash64(row), 'k', 0, 'own', named_struct('id', id, 'held_out', held_out, 'n_tokens', n_tokens, 'known', known, 'base', base, 'model', model))), "
                               "transform(words, (w, i) -> named_struct('w', w, 'k', times[i], 'own', null)))")).alias("item"),
    ).select("row", F.col("item.w").alias("word"), F.col("item.k").alias("k"), F.col("item.own").alias("own"))
    joined = items.join(counts.select("word", "n"), "word", "left")
    total = joined.groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs"),
    )
    below = float(np.log10(n + 0.1 * (kinds + 1)))
    base = F.col("own.base") + F.col("logs") - F.col("own.n_tokens") * below
    return total.select(
        F.col("own.id").alias(id_col),
        F.col("own.held_out").alias("held_out"),
        F.col("own.n_tokens").alias("n_tokens"),
        (F.col("own.known") + F.col("known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("own.model") + F.col("logs") if n else base).alias("score"),
    )
