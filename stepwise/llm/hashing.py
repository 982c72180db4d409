"""Vectorised 64-bit hashes of byte windows and word shingles (numpy, inside Spark tasks).

A window's hash is a polynomial of a random 64-bit code per byte, read off one running sum, so
every window of a text costs O(1) whatever its length. Hashes depend on content only, never on the
place in the text, the task or the run.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: bytes that end a word: space and \t \n \v \f \r
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand and kept for the task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(16, int(n - 1).bit_length())
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INV, np.uint64)]))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums S with S[j] - S[i] = the polynomial of data[i:j], shifted by BASE**i."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(CODES[data] * up[: len(data)], out=out[1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for arrays of bounds; equal bytes have equal hashes."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes that are not white space)."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(WHITE[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """One hash per word of the text, in order."""
    data = np.frombuffer(text, dtype=np.uint8)
    if lower:
        data = LOWER[data]
    start, end = word_bounds(data)
    return window_hash(prefix_sums(data), start, end) if len(start) else np.zeros(0, np.uint64)


def combine(parts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive items."""
    n = len(parts) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x100000001B3) + parts[k : k + n])
    return out


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles (fewer words: the whole sequence)."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(combine(words, min(width, len(words))))
