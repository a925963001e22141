"""Exact SentencePiece encoding of merge-type models by backtracking, and decoding (operator 6).

A token sequence is the encoding of a text exactly when every two neighbours, merged anew from their characters, come
out as the same two tokens: whether a pair of symbols is merged depends on its score and on leftmost-first order alone,
so the first merge over a token boundary would also happen in the text of those two tokens.  The search therefore walks
the text, takes at each position the longest piece that an Aho-Corasick automaton finds there, goes on to shorter ones
where the neighbours don't fit, and steps back where none is left; a bitfield of failed positions keeps it from entering
the same dead end twice.

No piece of such models goes on with a space, and none of this one's with another sign after a letter (both are checked on
loading), so a text falls into units that end before a space and after a run of letters; a worker remembers their encodings.

Defined cases: a null text counts as empty and gives no ids; characters without a piece become byte pieces; strings that
look like control or byte pieces are ordinary text; repeated rows and null ids pass through; an empty table gives an
empty result; only the id and text columns are read, so further columns cannot clash; texts have no length limit.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: What a worker remembers: encodings of units no longer than UNIT_CHARS, and checked pairs.  These only save time.
UNITS, UNIT_CHARS, PAIRS = 250_000, 48, 400_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: number, and int or bytes."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[i : i + size]
        i += size


class PieceModel:
    """Pieces, scores and kinds of one model file (its bytes)."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        known = {*self.kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        if trainer.get(3) != 2 or not trainer.get(35) or not known or trainer.get(24):
            raise ValueError("not a merge-type model with byte fallback and ordinary pieces only")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("its normalizer rewrites texts")
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown_text = trainer[44].decode("utf-8") if 44 in trainer else " ⁇ "
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.letters = {p for p in self.ids if len(p) == 1}
        if len(self.byte_ids) != 256 or any(c not in self.letters for p in self.ids for c in p):
            raise ValueError("it lacks byte pieces, or letters that its longer pieces have")


_NEVER = float("inf")


class _Units(dict):
    def __init__(self, codec: PieceCodec):
        super().__init__()
        self._codec = codec

    def __missing__(self, unit: str) -> tuple[int, str, str]:
        ids = self._codec.encode_unit(unit)
        found = len(ids), ",".join(map(str, ids)), self._codec.surface(ids)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = found
        return found


class PieceCodec:
    def __init__(self, data: bytes):
        self.model = model = PieceModel(data)
        self._rank = {p: -model.scores[i] for p, i in model.ids.items()}.get
        self._automaton = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            self._automaton.add_word(piece, (i, len(piece)))
        self._automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._units = _Units(self)
        letters = {c for c in model.letters if c.isalpha()}
        ends = not any(a in letters and b not in letters for p in model.ids for a, b in zip(p, p[1:], strict=False))
        if any(SPACE in p.lstrip(SPACE) for p in model.ids):
            self._cut = None  # a piece may reach over the end of a word: texts stay whole
        else:
            line = "" if "\n" in model.letters else "\n"
            inside = re.escape("".join(sorted(letters)))
            word = rf"(?:[^{SPACE}{line}{inside}]*[{inside}]+|[^{SPACE}{line}{inside}]+)" if ends else rf"[^{SPACE}{line}]+"
            self._cut = re.compile(rf"{SPACE}*{word}|{SPACE}+" + ("|\n" if line else ""))

    def merge(self, text: str) -> list[str]:
        """Symbols after all merges, best score first and leftmost among equals."""
        rank, part = self._rank, list(text)
        pairs = [rank(a + b, _NEVER) for a, b in zip(part, part[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == _NEVER:
                break
            i = pairs.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(part[i - 1] + part[i], _NEVER)
            if i < len(pairs):
                pairs[i] = rank(part[i] + part[i + 1], _NEVER)
        return part

    def fits(self, left: int, right: int) -> bool:
        """Whether the text of both tokens, merged anew, gives these two tokens."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            a, b = self.model.pieces[left], self.model.pieces[right]
            known = self.merge(a + b) == [a, b]
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _run(self, text: str) -> list[int]:
        """Encodes characters that all have pieces."""
        if text in self.model.ids and self.merge(text) == [text]:
            return [self.model.ids[text]]
        n = len(text)
        here: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by start: pieces, shortest first
        for end, (i, size) in self._automaton.iter(text):
            here[end + 1 - size].append((i, size))
        failed = bytearray(n // 8 + 1)
        tokens: list[int] = []
        tries: list[int] = [len(here[0])]  # by token: how many candidates at its start are still untried
        starts = [0]
        while True:
            at = starts[-1]
            found, left = here[at], tokens[-1] if tokens else -1
            k = tries[-1]
            while k:
                k -= 1
                i, size = found[k]
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1 and (left < 0 or self.fits(left, i)):
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                starts.pop()
                tries.pop()
                if not tokens:
                    raise AssertionError("merging always leaves an encoding")
                tokens.pop()
                continue
            tries[-1] = k
            tokens.append(i)
            if end == n:
                return tokens
            starts.append(end)
            tries.append(len(here[end]))

    def encode_unit(self, unit: str) -> list[int]:
        letters, out, i, n = self.model.letters, [], 0, len(unit)
        while i < n:
            j = i
            while j < n and unit[j] in letters:
                j += 1
            if j > i:
                out += self._run(unit[i:j])
            while j < n and unit[j] not in letters:
                out += [self.model.byte_ids[b] for b in unit[j].encode("utf-8")]
                j += 1
            i = j
        return out

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        return self._cut.findall(text) if self._cut else [text]

    def encode(self, text: str | None) -> list[int]:
        return [i for unit in self.cut(text or "") for i in self.encode_unit(unit)]

    def encode_fast(self, text: str | None) -> np.ndarray:
        """The same as ``encode``, with the encodings of units that were met before."""
        return np.fromstring(self.digest(text)[1], np.int32, sep=",") if text else np.empty(0, np.int32)

    def surface(self, ids: list[int]) -> str:
        """Text of the tokens, without taking off the prefix."""
        model, out, raw = self.model, [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(raw):  # a byte that starts no character becomes one replacement sign
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[i : i + size].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                i += size
            raw.clear()

        for i in ids:
            kind = model.kinds[i]
            if kind == BYTE:
                raw.append(model.bytes[i])
                continue
            if raw:
                flush()
            if kind == NORMAL:
                out.append(model.pieces[i].replace(SPACE, " "))
            elif kind == UNKNOWN:
                out.append(model.unknown_text)
        if raw:
            flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
        if self.model.prefix and first is not None and self.model.kinds[first] == NORMAL and text.startswith(" "):
            return text[1:]
        return text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and their decoding."""
        found = list(map(self._units.__getitem__, self.cut(text or "")))
        decoded = "".join([x[2] for x in found])
        return sum([x[0] for x in found]), ",".join([x[1] for x in found]), decoded[1:] if self.model.prefix and decoded.startswith(" ") else decoded


_CODECS: dict[bytes, PieceCodec] = {}


def _codec(data: bytes) -> PieceCodec:
    if data not in _CODECS:
        _CODECS.clear()
        _CODECS[data] = PieceCodec(data)
    return _CODECS[data]


def _ship(docs: DataFrame, model_path: str):
    """The model file, read on the driver, as a broadcast of its fixed size (about 0.5 MB)."""
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a further column of token ids.  ``ids_col`` must not be a column yet."""
    if ids_col in docs.columns:
        raise ValueError(f"column {ids_col} is there already")
    shipped, at = _ship(docs, model_path), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _codec(shipped.value).encode_fast
        for batch in batches:
            ids = pa.array([encode(t.as_py()) for t in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode_ids(docs: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with a further column of decoded texts (null ids: null)."""
    if text_col in docs.columns:
        raise ValueError(f"column {text_col} is there already")
    shipped, at = _ship(docs, model_path), docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _codec(shipped.value).decode
        for batch in batches:
            text = pa.array([None if x is None else decode(x) for x in (v.as_py() for v in batch.column(at))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, text_col])

    from pyspark.sql.types import StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(text_col, StringType())]))


def encode_checked(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids``, and ``round_trip``, whether they decode to the text.  One
    pass in one worker, which holds one codec."""
    shipped = _ship(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _codec(shipped.value).digest
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                size, ids, same = [], [], []
                for text in batch.column(1):
                    text = text.as_py() or ""
                    n, joined, decoded = digest(text)
                    size.append(n)
                    ids.append(np.fromstring(joined, np.int32, sep=",") if n else np.empty(0, np.int32))
                    same.append(decoded == text)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=["id", "n_tokens", "ids", "round_trip"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    shipped = _ship(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _codec(shipped.value).digest
        for batch in batches:
            rows = [digest(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([sha256(ids.encode()).hexdigest() for _, ids, _ in rows], pa.string()),
                    pa.array([sha256(text.encode()).hexdigest() for _, _, text in rows], pa.string()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
