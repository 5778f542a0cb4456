"""Periodic run detection: block matching over word numbers, with exact extension.

A run of period q holds at least 4 q words.  With B the power of two for
which B <= q < 2 B it holds a whole block of B words that begins at a multiple
of B, and the same block again q words later.  So for each scale B aligned
blocks are the keys of an automaton which searches the words around them: over
word numbers, and for blocks of more than eight words over the numbers of
stretches of B / 8 words, so that keys stay short.  An occurrence that begins
B to 2 B - 1 words after its aligned block seeds an extension to both sides.
How far words q apart agree is found by comparing prefix hashes at halving
steps, and what is long enough is compared word for word.

Blocks go into the automaton only where a run of the scale can be: in a run
every word but the last q is followed by itself less than 2 B words later, and
two runs have fewer words in common than their periods together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pieces
from .wordhash import mix, powers

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4
#: Numbers in a block's key at most.
KEY = 8
BASE = 0x9E3779B97F4A7C15
#: Bytes of text whose documents are searched together.
TEXT_BYTES = 4 << 20
RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered(words: list[bytes], base: int = 0) -> np.ndarray:
    """The number, from ``base``, of each word among the document's distinct words: equal words have equal numbers, no others."""
    known = dict.fromkeys(words)
    for i, w in enumerate(known, base):
        known[w] = i
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _ahead(ids: np.ndarray) -> np.ndarray:
    """For each word the distance to its next occurrence (beyond the end: the length)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    out = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _stretches(ok: np.ndarray, least: int) -> list[list[int]]:
    """[start, end) of the maximal stretches of true values that have at least ``least``."""
    edge = np.zeros(len(ok) + 2, np.int8)
    edge[1:-1] = ok
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    return np.stack([edge[::2], edge[1::2]], 1)[edge[1::2] - edge[::2] >= least].tolist()


class _Names:
    """Numbers for the document's stretches of 1, 2, 4, ... words; equal stretches have equal numbers, no others."""

    def __init__(self, ids: np.ndarray):
        self.known = {1: ids}

    def of(self, size: int) -> np.ndarray:
        if size not in self.known:
            half = self.of(size // 2)
            pair = half[: -size // 2] * len(half) + half[size // 2 :]
            self.known[size] = np.unique(pair, return_inverse=True)[1].ravel()
        return self.known[size]


def _seeds(names: np.ndarray, step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of aligned blocks of ``size`` words, and distances of ``size`` to 2 ``size`` - 1 at which they come again.

    ``names``: the number of the stretch of ``step`` words from each word on.
    A block is a key of size / step numbers; the numbers ``step`` words apart
    are searched in turn from each of the first ``step`` words.
    """
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    count = len(names) + step - 1
    kind = np.empty(count // size, np.int64)
    for j in range(len(kind)):
        block = tuple(names[j * size : (j + 1) * size : step].tolist())
        kind[j] = found.get(block, j)
        if kind[j] == j:
            found.add_word(block, j)
    found.make_automaton()
    rows = -(-len(names) // step)
    text = np.full((step, rows + 1), int(names.max()) + 1, np.int64)  # the last column keeps the turns apart
    text[:, :-1] = np.pad(names, (0, rows * step - len(names)), constant_values=int(names.max()) + 1).reshape(rows, step).T
    hits = np.array([x for x in found.iter(tuple(text.ravel().tolist()))], np.int64).reshape(-1, 2)
    start = (hits[:, 0] % (rows + 1) - size // step + 1) * step + hits[:, 0] // (rows + 1)
    block = start // size - 1  # the one aligned block that begins size to 2 size - 1 words before
    ok = block >= 0
    start, block, seen = start[ok], block[ok], hits[ok, 1]
    ok = kind[block] == seen
    return block[ok] * size, start[ok] - block[ok] * size


class _Reach:
    """How far the words at two places agree, forward and backward, for many pairs of places together."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.base = powers(BASE, self.n + 1)
        self.back = powers(pow(BASE, -1, 1 << 64), self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * self.base[: self.n], out=self.sums[1:])

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.back[a] == (self.sums[b + n] - self.sums[b]) * self.back[b]

    def _search(self, low: np.ndarray, high: np.ndarray, same) -> np.ndarray:
        """The largest number in [low, high] for which ``same`` holds; it holds at ``low``."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = same(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def stretch(self, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest [first, end) around ``at`` in which each word equals the one q later."""
        zero = np.zeros(len(at), np.int64)
        right = self._search(zero, self.n - at - q, lambda n: self._same(at, at + q, n))
        left = self._search(zero, at, lambda n: self._same(at - n, at - n + q, n))
        return at - left, at + right


def periodic_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """Every run (start, length, smallest period), by start, then period.

    ``ids`` may hold several documents one after another that have no number
    in common; ``longest``: the words of the longest of them.
    """
    longest, smallest = len(ids) if longest is None else longest, {}
    if longest < LEAST:
        return []
    ahead = _ahead(ids)
    size = 1
    while TIMES * size <= longest:
        least = max(LEAST - 2 * size + 1, (TIMES - 1) * size)  # words of the shortest run of this scale that come again
        before = sorted(smallest)  # runs of smaller periods
        starts = np.array([s for s, _ in before], np.int64)
        reach = np.maximum.accumulate(np.array([s + m for s, m in before] or [0], np.int64))
        for a, b in _stretches(ahead < 2 * size, least):
            end = min(len(ids), b + 2 * size)  # with the last words' partners
            i, j = int(np.searchsorted(reach, a, side="right")), int(np.searchsorted(starts, end))
            if any((end - a) - (min(end, s + m) - max(a, s)) < 2 * size for s, m in before[i:j]):
                continue  # a new run has at least 2 q of its words outside of any other one
            for s, m, p in _runs_of_scale(ids[a:end], size):
                smallest.setdefault((a + s, m), p)
        size *= 2
    return sorted(((s, m, p) for (s, m), p in smallest.items()), key=lambda r: (r[0], r[2]))


def _runs_of_scale(part: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Stretches (start, length, period) of ``part`` with a period of ``size`` to 2 ``size`` - 1, each once, with its smallest one of these.

    Of the periods of one stretch the smallest divides the others; it belongs
    to this scale or to one before.
    """
    step = max(1, size // KEY)
    at, q = _seeds(_Names(part).of(step), step, size)
    if not len(at):
        return []
    first, end = _Reach(part).stretch(at, q)
    length = end - first + q
    ok = length >= np.maximum(LEAST, TIMES * q)
    first, length, q = first[ok], length[ok], q[ok]
    order = np.lexsort((q, length, first))
    once = order[np.diff(first[order], prepend=-1).astype(bool) | np.diff(length[order], prepend=-1).astype(bool)]
    out = []
    for s, m, p in zip(first[once].tolist(), length[once].tolist(), q[once].tolist(), strict=True):
        if _keeps(part, s, m, p):
            out.append((s, m, p))
        else:  # unequal words with equal hashes: look at all words
            out += [(x, y - x + p, p) for x, y in _stretches(part[:-p] == part[p:], max(LEAST, TIMES * p) - p)]
    return sorted(out, key=lambda r: r[2])


def _keeps(ids: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether words q apart are identical in all of the run."""
    return bool((ids[start : start + length - q] == ids[start + q : start + length]).all())


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The document with a periodic tail, where its hash asks for one."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of RESULT for one document, its runs and the text that is kept."""
    kept = words
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    said, text = "".join(f"{s},{n},{q}\n" for s, n, q in runs), b" ".join(kept)
    return (len(words), len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), runs, text)


def described(documents: list[list[bytes]]) -> Iterator[tuple]:
    """``describe`` for each of many documents, searched together."""
    ids, base, ends = [np.zeros(0, np.int64)], 0, []
    for words in documents:
        ids.append(numbered(words, base))
        base += len(words)
        ends.append(base)
    found = periodic_runs(np.concatenate(ids), max(map(len, documents), default=0))
    at, start = 0, 0
    for words, end in zip(documents, ends, strict=True):
        runs = []
        while at < len(found) and found[at][0] < end:
            runs.append((found[at][0] - start, *found[at][1:]))
            at += 1
        yield describe(words, runs)
        start = end


def find_periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, details: bool = False) -> DataFrame:
    """One row for each document: the id and the columns of ``RESULT``, with ``details`` also runs and collapsed (text).

    Words are separated by space and 0x09-0x0D.  A run is a stretch of words
    with smallest period q, of at least 6 and at least 4 q words, that no
    neighbouring word extends.  The longest run's columns (ties: the first
    start, then the smallest period) are null without a run.  ``collapsed``
    lacks each word that a run contains after its first q words.  ``plant``
    first gives one document in ten a periodic tail, chosen by the crc32 of
    its id (a null id: of the empty text).  Null, empty and blank texts have
    no words; rows given twice give rows twice, an empty table none; other
    columns are ignored.  Each document is one row's work in memory.
    """
    extra = ["runs", "collapsed"] if details else []
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {RESULT}" + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if details else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(x.split()[0] for x in RESULT.split(", ")), *extra]
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()][: len(extra)]
        for batch in batches:
            for part in pieces(batch, 2, TEXT_BYTES):
                texts = [(x.as_buffer().to_pybytes() if x.is_valid else b"").split() for x in part.column(2)]
                if plant:
                    texts = [planted(words, crc32(name.encode())) for name, words in zip(part.column(1).to_pylist(), texts, strict=True)]
                rows = list(described(texts))
                columns = [part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types[:8]))]
                if details:
                    columns += [pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r[8]] for r in rows], types[8]), pa.array([r[9].decode() for r in rows], types[9])]
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
