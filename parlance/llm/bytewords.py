"""Words, word hashes and shingles of a batch of texts as numpy arrays,
straight from the UTF-8 buffer, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
# Odd multipliers; any fixed odd numbers do.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20_240).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """``start``/``end`` (byte offsets, end exclusive) of every word of a
    batch and ``first[i]:first[i + 1]``, the words of text ``i``."""
    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, from prefix sums of a polynomial in an
        odd base (which has an inverse modulo 2**64)."""
        n = len(self.buffer)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.buffer] * _powers(_BASE, n), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _powers(_INVERSE, n)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))


def words_of(texts: list[bytes], lower: bool = True, breaks: np.ndarray = _SPACE) -> Words:
    """The words of ``texts``, with A-Z lower-cased if asked. ``breaks``
    marks the bytes between words, the space among them (else: ASCII white
    space)."""
    # One space after each text keeps the words of two texts apart.
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    edge = np.diff(np.concatenate(([False], ~breaks[buffer], [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return Words(buffer, start, end, np.searchsorted(start, begin))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, with repeats, and
    where each text's begin. A text of fewer words has one, of all of them;
    a text without words has none."""
    word = words.hashes()
    counts = np.diff(words.first)
    n = len(word)
    turned = [mix(word + c) for c in _BASE * np.arange(1, 2 * size, 2, dtype=np.uint64)]
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total[:max(n - k, 0)] += turned[k][k:]
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(number, out=first[1:])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], number)
    out = total[np.repeat(words.first[:-1], number) + inside]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = slice(words.first[i], words.first[i + 1])
        parts = np.array([counts[i], *(turned[k][own][k] for k in range(counts[i]))], np.uint64)
        out[first[i]] = (parts * np.array([_INVERSE, *[1] * counts[i]], np.uint64)).sum(dtype=np.uint64)
    return mix(out), first
