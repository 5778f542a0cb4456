"""Hashes of windows of texts' bytes, for a join of each text with the longer texts that hold it.

The first window of a text begins early in it, the last one ends late, and
they overlap, so that a text with both holds nearly all of it.  In long texts
windows begin where the hash of the next ``GRAM`` bytes has zeros in its lowest
bits, which is so wherever the same bytes stand.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that decide whether a window may begin at a place.
GRAM = 8
#: One place in so many is a beginning.
SAMPLE = 32
#: Windows of shorter texts, and of those without a beginning in their first half, cover the whole text.
LEAST = 256
#: Windows of so many bytes or more are sought only where their first so many bytes are wanted.
LARGE = 32
#: Texts of so many bytes together are hashed at a time.
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64(SAMPLE - 1)
_powers: list[np.ndarray] = []

PIECES = "s_length long, sampled boolean, piece long, other long, size long, marks array<long>"


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n + SEGMENT, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    x = x + np.uint64(size * 0xD1342543DE82EF95 & (1 << 64) - 1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Segment:
    """Some texts of a batch, back to back: ``offsets`` has one entry more than there are texts."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.offsets = first, offsets
        power, self.back = _factors(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODES[data] * power[: len(data)], out=self.sums[1:])
        n = max(0, len(data) - GRAM + 1)
        self.grams = _mixed((self.sums[GRAM:] - self.sums[:n]) * self.back[:n], GRAM) if n else np.zeros(0, np.uint64)

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """The pieces of the windows of ``size`` bytes; their lowest bits are those of the first bytes' hash."""
        h = _mixed((self.sums[at + size] - self.sums[at]) * self.back[at], size)
        return h if size < GRAM else h & ~_LOW | self.grams[at] & _LOW


def _segments(texts: pa.Array) -> Iterator[_Segment]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SEGMENT, "right")) - 1)
        yield _Segment(k, data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k])
        k = end


def own_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PIECES`` after the id of each (id, text): the first and the last window of the text, of one size, and as marks the inverted hashes of their first ``GRAM`` and ``LARGE`` bytes.

    Texts shorter than ``GRAM`` are one window.
    """
    for batch in batches:
        rows = []
        for s in _segments(batch.column(1)):
            places = np.flatnonzero((s.grams & _LOW) == 0)
            for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist()):
                n = b - a
                k = int(np.searchsorted(places, a))
                sampled = n >= LEAST and k < len(places) and int(places[k]) <= a + n // 2
                first = int(places[k]) if sampled else a
                size = n if n < GRAM else 1 << (b - first).bit_length() - 1
                last = int(places[np.searchsorted(places, b - size, "right") - 1]) if sampled else b - size
                both = np.array([first, last])
                piece, other = s.windows(both, size).view(np.int64).tolist()
                marks = (~s.grams[both]).view(np.int64).tolist() if n >= GRAM else []
                if size >= LARGE:
                    marks += (~s.windows(both, LARGE)).view(np.int64).tolist()
                rows.append((n, sampled, piece, other, size, marks))
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["s_id", "s_length", "sampled", "piece", "other", "size", "marks"])


def _inside(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """The places of the hashes whose two bits are set; see ``relate._table``."""
    at = np.arange(len(h))
    for shift in (0, 28):
        slot = (h[at] << np.uint64(shift)) >> np.uint64(64 - bits)
        at = at[(words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
    return at


def held_windows(sizes: list[int], table) -> Callable:
    """(id, l_length, piece) for each (id, text): once each, the windows of these sizes, in ascending order, whose bits the broadcast table has."""

    large = min((n for n in sizes if n >= LARGE), default=None)

    def run(batches):
        words, bits = table.value
        for batch in batches:
            rows, pieces, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in _segments(batch.column(1)):
                length = np.diff(s.offsets)
                ends = np.repeat(s.offsets[1:], length)
                starts = _inside(~s.grams, words, bits)
                found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for size in sizes:
                    if size == large:
                        starts = starts[starts + LARGE <= ends[starts]]
                        starts = starts[_inside(~s.windows(starts, LARGE), words, bits)]
                    at = starts if size >= GRAM else np.arange(len(ends))
                    at = at[at + size <= ends[at]]
                    h = s.windows(at, size)
                    keep = _inside(h, words, bits)
                    found[0].append(np.searchsorted(s.offsets, at[keep], "right") - 1)
                    found[1].append(h[keep])
                row, h = map(np.concatenate, found)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                rows.append(row[new] + s.first)
                pieces.append(h[new])
                lengths.append(length[row[new]])
            at, h, n = map(np.concatenate, (rows, pieces, lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n.astype(np.int64)), pa.array(h.view(np.int64))], names=["l_id", "l_length", "piece"])

    return run
