"""Hashes of words and of word n-grams, computed on whole UTF-8 texts with numpy.

Words are the longest runs of bytes other than 0x20 and 0x09-0x0D.  A word's hash is a polynomial over random 64-bit
values of its bytes, read off prefix sums; an n-gram's hash combines those of its words and is mixed at the end.  Equal
n-grams always have equal hashes; two different ones agree with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 1
_STEPS = _rng.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; longer texts are cut at white space.
PIECE = 1 << 20

_POWERS = np.ones(1, _U)
_INVERSES = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, 2 * len(_POWERS), 1 << 14)
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[_U(1)], np.full(n - 1, _U(_BASE))]).cumprod(dtype=_U)
            _INVERSES = np.concatenate([[_U(1)], np.full(n - 1, _U(pow(_BASE, -1, 1 << 64)))]).cumprod(dtype=_U)
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _piece(data: np.ndarray) -> np.ndarray:
    return split_words(data, np.zeros(1, np.int64))[0]


def split_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of all words in texts that follow each other and begin at ``begins``."""
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = begins[(begins > 0) & (begins < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.empty(0, _U), starts, ends
    powers, inverses = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTES[data] * powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(_U)), starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word, in order."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= PIECE:
        return _piece(data)
    out, at = [], 0
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        out.append(_piece(data[at:stop]))
        at = stop
    return np.concatenate(out)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` words, in order; a shorter text has one n-gram, all its words (none: no n-gram)."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        total = words[: len(words) - n + 1] * _STEPS[0]
        for k in range(1, n):
            total = total + words[k : len(words) - n + 1 + k] * _STEPS[k]
        return mix(total + _U(n))


def ngram_set(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    return np.unique(ngram_hashes(word_hashes(text), n))
