"""URL filters as a bit-parallel (Shift-And) automaton over many globs at once.

A glob is a sequence of literal bytes and stars.  Its positions become bits,
all globs lie side by side in 64-bit words, and one step of the automaton
moves every glob over one symbol of every url in a batch.  A url is read as
``.`` + host + MARK + path, where MARK is a symbol outside the bytes, so that
a star in the host part can be kept from running into the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, SYMBOLS = 256, 257
HOST_STAR, STAR = -1, -2  # a star over host symbols only; over any symbol


@dataclass(frozen=True)
class Glob:
    tokens: tuple[int, ...]
    allow: bool
    rank: int  # the highest rank that fits decides
    name: str | None


def rule(verdict: str, host: str, path: str) -> Glob:
    """A rule for a host with its subdomains and a path's beginning; the longest rule wins."""
    tokens = (HOST_STAR, *b".", *host.encode(), MARK, *path.encode(), STAR)
    return Glob(tokens, verdict == "allow", len(host) + len(path), host + path)


def glob(verdict: str, path: str) -> Glob:
    """A glob over the whole path; decides only where no rule fits."""
    tokens = (HOST_STAR, MARK, *(STAR if c == 42 else c for c in path.encode()))
    return Glob(tokens, verdict == "allow", -1, None)


class ShiftAnd:
    def __init__(self, globs: list[Glob]):
        letters: list[int] = []  # the symbol that each bit consumes
        first, last, loops = [], [], []
        for g in globs:
            # bit 0 of a glob is its start state; each literal adds a state
            first.append(len(letters))
            letters.append(-9)
            for t in g.tokens:
                if t in (HOST_STAR, STAR):
                    loops.append((len(letters) - 1, t))
                else:
                    letters.append(t)
            last.append(len(letters) - 1)
        self.n_words = -(-len(letters) // 64)
        self.table = np.zeros((SYMBOLS, self.n_words), np.uint64)
        self.loop = np.zeros((SYMBOLS, self.n_words), np.uint64)
        self.start = np.zeros(self.n_words, np.uint64)
        put = lambda row, bit: row.__setitem__(bit // 64, row[bit // 64] | np.uint64(1 << (bit % 64)))
        for bit, t in enumerate(letters):
            if t >= 0:
                put(self.table[t], bit)
        for bit, t in loops:
            for symbol in range(SYMBOLS if t == STAR else MARK):
                put(self.loop[symbol], bit)
        for bit in first:
            put(self.start, bit)
        self.last = np.array(last)

    def run(self, symbols: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs fit each of the sequences: a matrix of sequences by globs."""
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.start, (len(lengths), 1))
        ending = lengths[order]
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-ending, -step, side="left"))
            seen = symbols[offsets[order[:live]] + step]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.table[seen]) | (now & self.loop[seen])
        out = np.zeros((len(lengths), len(self.last)), bool)
        out[order] = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1) != 0
        return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host and path: see ``filter_urls``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    stops = [i for i in map(tail.find, "?#") if i >= 0]
    return host, tail[: min(stops, default=len(tail))]


def filter_urls(pages: DataFrame, globs: list[Glob], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: id, host, path, rule, verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: then up to ``?``, ``#`` or the end.  Null urls and urls
    without ``://`` have neither, fit no rule and get the default unless a glob
    fits the empty path.  Where several of the globs without a rule fit, block
    wins.  Very long urls cost one step for each byte.  Rows given twice give
    two rows; other columns are ignored.  The rules are a parameter, so their
    number does not grow with the data.
    """
    machine = ShiftAnd(globs)
    ranks = np.array([2 * g.rank + (not g.allow) for g in globs])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                both = [host_and_path(x) for x in part.column(1).to_pylist()]
                coded = [np.concatenate([np.frombuffer(b"." + h.encode(), np.uint8).astype(np.int16), [MARK], np.frombuffer(p.encode(), np.uint8)]).astype(np.int16) for h, p in both]
                lengths = np.array([len(x) for x in coded])
                fits = machine.run(np.concatenate(coded), lengths, np.cumsum(lengths) - lengths)
                score = np.where(fits, ranks, -9)
                best = score.argmax(axis=1)
                rules, verdicts = [], []
                for i, g in enumerate(best.tolist()):
                    hit = score[i, g] > -9
                    rules.append(globs[g].name if hit else None)
                    verdicts.append(("allow" if globs[g].allow else "block") if hit else default)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.string()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return rows.mapInArrow(judge, schema).withColumnRenamed("id", id_col)
