"""Token counts by byte-pair merging on a heap and a linked list (operator 4).

Each text is cut at the special strings of the vocabulary and then by the vocabulary's pre-token pattern.  A pre-token
starts as one symbol per UTF-8 byte; the adjacent pair of lowest rank (ties: leftmost) is merged again and again, from a
heap of pairs over a doubly linked list of symbols.  The count is the number of initial symbols less the number of
merges, so no identifiers are ever made.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); lone or repeated white space follows the
pattern; rows are independent, so ties, repeated rows and null ids pass through unchanged; an empty table gives an empty
result; only the named id and text columns are read, so further columns cannot clash.  A pre-token of any length costs
n log n, and none is cut short.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and numbers that the tokenizer library's Unicode tables do not hold yet, so that it takes them
#: for "other" characters.
YOUNG = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]

#: Pre-tokens whose count a worker remembers, and the longest that it remembers.  Both only save time.
CACHE_SIZE = 400_000
CACHE_CHARS = 48


def _pattern(young: str) -> str:
    letter, number = (rf"[\p{{{k}}}--[{young}]]" if young else rf"\p{{{k}}}" for k in "LN")
    other = rf"[^\s\p{{L}}\p{{N}}{young}]" if not young else rf"(?:[^\s\p{{L}}\p{{N}}]|[{young}])"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


#: For texts without any character from U+0558 on, and for all others.
_PLAIN = regex.compile(_pattern(""))
_FULL = regex.compile(_pattern("".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in YOUNG)), regex.V1)
_BEYOND = regex.compile("[՘-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Counts(dict):
    def __init__(self, count):
        super().__init__()
        self._count = count

    def __missing__(self, token: str) -> int:
        n = self._count(token)
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[token] = n
        return n


class MergeCounter:
    """Counts tokens under the merges of one byte-level vocabulary (the bytes of its .json file)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a byte-level byte-pair vocabulary without a normalizer")
        ids = model["vocab"]
        self._start = [ids[c] for c in byte_letters()]
        #: (left id << 32 | right id) -> (rank, id of both together)
        self._merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._merge.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._counts = _Counts(self.count_pretoken)

    def count_pretoken(self, token: str) -> int:
        data = token.encode("utf-8")
        n = len(data)
        if n == 1:
            return 1
        merge = self._merge
        symbol = [self._start[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            hit = merge.get(symbol[i] << 32 | symbol[i + 1])
            if hit:
                heap.append((hit[0], i, hit[1]))
        heapify(heap)
        merges = 0
        while heap:
            rank, i, new = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n or merge.get(symbol[i] << 32 | symbol[j], (-1,))[0] != rank:
                continue  # one side has gone into another symbol since
            symbol[i], symbol[j] = new, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = merge.get(new << 32 | symbol[k])
                if hit:
                    heappush(heap, (hit[0], i, hit[1]))
            h = before[i]
            if h >= 0:
                hit = merge.get(symbol[h] << 32 | new)
                if hit:
                    heappush(heap, (hit[0], h, hit[1]))
        return n - merges

    def _plain(self, text: str) -> int:
        found = (_FULL if _BEYOND.search(text) else _PLAIN).findall(text)
        return sum(map(self._counts.__getitem__, found))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        special = self._special
        if special is None or not special.search(text):
            return self._plain(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_COUNTERS: dict[bytes, MergeCounter] = {}


def _counter(vocabulary: bytes) -> MergeCounter:
    """One counter for each vocabulary in a worker, kept between tasks."""
    if vocabulary not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[vocabulary] = MergeCounter(vocabulary)
    return _COUNTERS[vocabulary]


def count_tokens(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The vocabulary file is read on the driver and goes to the workers as a broadcast of its fixed size (about 1.5 MB).
    """
    with open(vocabulary_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shipped.value).count
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
