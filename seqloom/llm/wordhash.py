"""Vectorised polynomial hashes of words and of runs of words.

A text buffer holds many documents back to back.  Words are maximal runs of
bytes outside space and 0x09-0x0D; they never cross a document boundary.
All arithmetic is modulo 2**64 with odd multipliers, finished by a bijective
mixer, so hashes agree in every process.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bases for bytes and for words: the usual ones, and independent ones for a second hash.
BASES = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``buf``, and for every document the index of its first word.

    ``offsets`` has one entry more than there are documents.
    """
    solid = ~SPACE[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[(offsets < len(buf))]
    begin[inner] = solid[inner]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    last = offsets[offsets > 0] - 1
    end[last] = solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """One 64-bit hash for every word; ``which`` chooses one of two."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    value = (buf[at].astype(np.uint64) + np.uint64(1)) * powers(BASES[which][0], int(lengths.max()))[within]
    total = np.add.reduceat(value, first)
    return mix(total ^ (lengths.astype(np.uint64) << np.uint64(48)))


def run_hashes(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Rolling (Rabin-Karp) hash of every run of ``n`` consecutive word hashes; ``which`` chooses one of two."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = BASES[which][1]
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    m = len(hashes) - n + 1
    return mix((total[n:] - total[:m]) * powers(pow(base, -1, 1 << 64), m) + np.uint64(n))
