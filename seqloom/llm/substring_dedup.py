"""Removal of word windows that occur more than once (Rabin-Karp substring dedup).

Every window of ``width`` consecutive words is hashed with a rolling hash.
Window hashes are counted over all documents in Spark (see ``blocks``), and
the words under repeated windows merge into maximal removal intervals.
Windows are judged on the input, so every copy of a repeated passage goes.

Windows that occur again by their 64-bit hash are counted once more by a second,
independent one, so two different windows count as one only if they agree in
128 bits: 100 TB of text hold about 2 * 10**13 windows, which meet by chance with
a probability of about 10**-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import counted, pack, text_buffers, totals, unpacked
from .wordhash import run_hashes, word_hashes, words


class _Windows:
    """The windows of a batch of texts: each one's first word, its place among the distinct hashes, and these."""

    def __init__(self, column: pa.Array, width: int, key_bits: int) -> None:
        self.width = width
        self.buf, offsets = text_buffers(column)
        self.starts, self.ends, self.first = words(self.buf, offsets)
        hashes = run_hashes(word_hashes(self.buf, self.starts, self.ends), width)
        length = np.diff(self.first)
        inside = np.repeat(self.first[1:], length)[: len(hashes)] - np.arange(len(hashes)) >= width
        self.at = np.flatnonzero(inside)
        shift = np.uint64(64 - key_bits)
        self.keys, self.place, self.times = np.unique(hashes[self.at] >> shift << shift, return_inverse=True, return_counts=True)

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Which words lie in the windows at ``at``."""
        edge = np.zeros(self.first[-1] + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.width, -1)
        return np.cumsum(edge)[:-1] > 0

    def second(self, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows whose keys occur again, their distinct second hashes, each window's place there, and the times of each."""
        at = self.at[again[self.place]] if len(self.keys) else self.at
        word = np.flatnonzero(self.covered(at))
        hashes = np.zeros(len(self.starts), np.uint64)
        hashes[word] = word_hashes(self.buf, self.starts[word], self.ends[word], 1)
        runs = run_hashes(hashes, self.width, 1)
        return at, *np.unique(runs[at], return_inverse=True, return_counts=True)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, keep_text: bool = False, key_bits: int = 64, block_bytes: int | None = None) -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept_sha256, intervals, and with ``keep_text`` kept_text.

    ``intervals`` lists maximal removed word ranges [first, end).  Null and
    empty texts have no words and lose nothing; a row given twice repeats all
    its windows, in both rows; texts shorter than ``width`` are kept whole.
    Other columns of ``docs`` are ignored; an empty table gives no rows.  The
    result depends neither on ``key_bits``, the bits of the first hash in use,
    nor on ``block_bytes`` (see ``blocks``).
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def keys_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        windows = _Windows(rows.column(1), width, key_bits)
        return windows.keys, windows.times

    found, bits = counted(pack(kept, "text", block_bytes), keys_of, 0.17)

    def second_of(rows: pa.RecordBatch, answers) -> tuple[np.ndarray, np.ndarray]:
        windows = _Windows(rows.column(1), width, key_bits)
        _, keys, _, times = windows.second(totals(windows.keys, answers, bits) > 1)
        return keys, times

    found, second_bits = counted(found, second_of, 0.05, "second", ("answers",))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers, second in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                block = unpacked(payload.as_buffer())
                windows = _Windows(block.column(1), width, key_bits)
                at, keys, place, _ = windows.second(totals(windows.keys, answers, bits) > 1)
                gone = windows.covered(at[totals(keys, second, second_bits)[place] > 1])
                first = windows.first
                shas, spans, texts, removed = [], [], [], []
                for i, text in enumerate(block.column(1).cast(pa.binary())):
                    own = gone[first[i] : first[i + 1]]
                    every = (text.as_py() or b"").split()
                    removed.append(int(own.sum()))
                    if removed[-1]:
                        every = compress(every, (~own).tolist())
                        steps = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                        spans.append([{"first": a, "end": b} for a, b in zip(steps[::2], steps[1::2], strict=True)])
                    else:
                        spans.append([])
                    left = b" ".join(every)
                    shas.append(hashlib.sha256(left).hexdigest())
                    if keep_text:
                        texts.append(left.decode())
                columns = [block.column(0), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
                names = ["id", "n_words", "n_removed", "kept_sha256", "intervals"]
                if keep_text:
                    columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string, intervals array<struct<first: long, end: long>>" + ", kept_text string" * keep_text
    return found.select("payload", "answers", "second").mapInArrow(remove, schema).withColumnRenamed("id", id_col)
