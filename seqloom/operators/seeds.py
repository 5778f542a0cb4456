"""Candidate pairs for alignment and near containment, from words that both sides share (no pair is compared twice).

``seeded_pairs`` is for remote pairs: words over groups of like residues, with
places left open, two of them on one diagonal, and an ungapped extension.
``near_contained_pairs`` is for texts that nearly contain another: a piece of
known least length is common to both, so both choose one same word of it.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import ALIKE, default_scores
from ..plans.scratch import materialize

#: Shapes of words: residues at a 1 count.  Several shapes see what one alone misses.
SHAPES = ("11111", "110111", "1101011", "11001011")
#: Two words of one diagonal at most so many residues apart.
REACH = 60
#: An extension stops when it has lost so much; what it must reach to make a candidate.
DROP, LEAST = 12, 18
SALTS = 16
#: Words of more sequences than this are dealt over SALTS tasks.
FREQUENT = 2000


def seed_words(sequences: DataFrame, node: str, sequence: str, shapes: tuple[str, ...] = SHAPES) -> DataFrame:
    """(node, word, place): the shaped words of each sequence over groups of residues; the word tells its shape."""
    letters = "".join(ALIKE)
    groups = F.translate(F.upper(F.col(sequence)), letters, "".join(chr(97 + i) * len(g) for i, g in enumerate(ALIKE)))
    rows = sequences.select(F.col(node).alias("node"), groups.alias("text"))

    def words(number: int, shape: str):
        def word(at):
            return F.struct(F.concat(F.lit(str(number)), *(F.substring(F.col("text"), at + j, F.lit(1)) for j, c in enumerate(shape) if c == "1")).alias("word"), at.alias("place"))

        count = F.length("text") - len(shape) + 1
        return F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), word)

    return rows.select("node", F.inline(F.concat(*(words(i, shape) for i, shape in enumerate(shapes)))))


def _extended(scores: dict[str, dict[str, int]], drop: int):
    table = np.full((128, 128), -4, np.int64)
    for a, row in scores.items():
        for b, value in row.items():
            table[ord(a), ord(b)] = value

    def reach(values: np.ndarray) -> int:
        """The best sum of a prefix, up to where the sum is ``drop`` below the best so far."""
        sums = np.cumsum(values)
        low = np.flatnonzero(np.maximum.accumulate(np.maximum(sums, 0)) - sums > drop)
        return int(max(0, sums[: low[0] if len(low) else len(sums)].max(initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for diagonal, place, a, b in zip(*(batch.column(c).to_pylist() for c in ("diagonal", "place", "x", "y")), strict=True):
                x, y = (np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8) for s in (a, b))
                first = max(0, diagonal)
                n = min(len(x) - first, len(y) - first + diagonal)
                values = table[x[first : first + n], y[first - diagonal : first - diagonal + n]]
                at = place - 1 - first
                out.append(reach(values[at:]) + reach(values[:at][::-1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.int64())], ["a", "b", "reach"])

    return run


def seeded_pairs(sequences: DataFrame, node: str, sequence: str, shapes: tuple[str, ...] = SHAPES, least: int = LEAST, hits: int = 2, scores: dict | None = None) -> DataFrame:
    """(a, b, reach), a < b: pairs with ``hits`` words on one diagonal within REACH residues, and an ungapped extension of at least ``least``.

    ``hits`` = 1 takes every common word.  Words that many sequences share are
    dealt over several tasks; their pairs are as many as the words ask for.
    """
    words = materialize(seed_words(sequences, node, sequence, shapes), "words")
    counts = words.groupBy("word").agg(F.count("*").alias("size")).where("size > 1")
    known = materialize(words.join(counts.hint("merge"), "word"), "known")
    frequent = F.col("size") > FREQUENT
    left = known.select("word", F.col("node").alias("a"), F.col("place").alias("p"), F.when(frequent, F.pmod(F.xxhash64("node", "place"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    right = known.select("word", F.col("node").alias("b"), F.col("place").alias("q"), F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    met = left.join(right.hint("merge"), ["word", "salt"]).where("a < b").select("a", "b", (F.col("p") - F.col("q")).alias("diagonal"), "p")
    # the places of one pair's diagonal are no more than its residues
    near = met.groupBy("a", "b", "diagonal").agg(F.array_sort(F.collect_set("p")).alias("p"))
    two = F.exists(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("u"), F.expr("slice(p, 2, size(p))").alias("v")), lambda z: z["v"] - z["u"] <= REACH)
    chosen = near.where(two) if hits > 1 else near
    chosen = materialize(chosen.select("a", "b", "diagonal", F.get("p", F.lit(0)).alias("place")), "diagonals")
    text = sequences.select(F.col(node).alias("node"), F.col(sequence).alias("sequence"))
    rows = chosen.join(text.select(F.col("node").alias("a"), F.col("sequence").alias("x")).hint("merge"), "a").join(text.select(F.col("node").alias("b"), F.col("sequence").alias("y")).hint("merge"), "b")
    kind = text.schema["node"].dataType.simpleString()
    found = rows.select("a", "b", "diagonal", "place", "x", "y").mapInArrow(_extended(scores or default_scores(), DROP), f"a {kind}, b {kind}, reach long")
    return found.where(F.col("reach") >= least).groupBy("a", "b").agg(F.max("reach").alias("reach"))


# --- near containment ------------------------------------------------------------------------------------------------

#: Share of a text that must lie in common pieces; the shortest anchor word.
COVER, SHORTEST = 0.92, 4


def least_piece(length: int, cover: float, gaps: int) -> int:
    """The longest of ``gaps`` + 1 pieces that make up ``cover`` of so many characters has at least this length."""
    return -int(-cover * length // (gaps + 1))


def window(length: int, cover: float, gaps: int) -> tuple[int, int] | None:
    """Characters of a word, and words among which one is chosen, powers of two; the piece holds all of them.  None: the piece is shorter than the shortest word."""
    piece = least_piece(length, cover, gaps)
    if piece < SHORTEST:
        return None
    word = max(SHORTEST, 1 << (2 * piece // 3).bit_length() - 1)
    return word, 1 << (piece - word + 1).bit_length() - 1


def anchors(text: str, word: int, size: int) -> set[int]:
    """The least hashed word of every ``size`` successive words of a text, or of all where there are fewer."""
    codes = np.array([ord(c) for c in text], np.uint64)
    count = len(codes) - word + 1
    if count <= 0:
        return set()
    h = np.zeros(count, np.uint64)
    for i in range(word):
        h = (h ^ codes[i : count + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    span, size = 1, min(size, count)
    while span < size:  # the least of 1, 2, 4, ... successive words
        step = min(span, size - span)
        h = np.minimum(h[:-step], h[step:])
        span += step
    return set(np.unique(h).tolist())


def covered(short: str, long: str, cover: float, gaps: int) -> float | None:
    """The share of ``short`` in matching blocks with ``long``, if it is ``cover`` or more in ``gaps`` + 1 blocks at most."""
    need = cover * len(short)
    if sum((Counter(short) & Counter(long)).values()) < need - 1e-9:  # blocks hold no more than the common letters
        return None
    blocks = [m.size for m in difflib.SequenceMatcher(None, long, short, autojunk=False).get_matching_blocks() if m.size]
    return sum(blocks) / len(short) if len(blocks) <= gaps + 1 and sum(blocks) >= need - 1e-9 else None


def near_contained_pairs(texts: DataFrame, node: str, text: str, cover: float = COVER, gaps: int = 2) -> DataFrame:
    """(short, long, coverage): texts of which ``cover`` lies in at most ``gaps`` + 1 matching blocks with a longer text.

    Of texts of equal length the one of the smaller node counts as short;
    equal texts cover each other wholly.  One block has at least
    cover / (gaps + 1) of the shorter text, so both texts choose the same word
    of it (the least hashed one of a window that it holds).  A text too short
    for a word in its least piece is no short side: see ``relate.containment``.
    Null texts match nothing.
    """
    id_type = texts.schema[node].dataType.simpleString()
    rows = texts.select(F.col(node).alias("node"), F.col(text).alias("text")).where(F.length("text") >= SHORTEST)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = sorted({window(n, cover, gaps) for n in batch.column(0).to_pylist()} - {None})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.int64()) for i in (0, 1)], ["word", "size"])

    # words and windows are powers of two, and follow from the length: a few dozen pairs whatever the texts
    kinds = [tuple(r) for r in rows.select(F.length("text").alias("n")).distinct().mapInArrow(forms, "word long, size long").distinct().collect()]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = window(len(value), cover, gaps)
                for word, size in kinds:
                    for chosen in anchors(value, word, size):
                        key = (chosen * 31 + word * 64 + size) % (1 << 64)
                        for column, x in zip(out, (key - (1 << 64) if key >> 63 else key, (word, size) == own, name, len(value)), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], batch.schema.field(0).type), pa.array(out[3], pa.int64())], ["key", "own", "node", "length"])

    words = materialize(rows.mapInArrow(choose, f"key long, own boolean, node {id_type}, length long"), "anchors")
    short = words.where("own").select("key", F.col("node").alias("short"), F.col("length").alias("n"))
    long = words.select("key", F.col("node").alias("long"), F.col("length").alias("m"))
    pairs = materialize(short.join(long.hint("merge"), "key").where("m > n or m = n and short < long").select("short", "long").distinct(), "pairs")
    both = pairs.join(rows.select(F.col("node").alias("short"), F.col("text").alias("x")).hint("merge"), "short").join(rows.select(F.col("node").alias("long"), F.col("text").alias("y")).hint("merge"), "long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [covered(x, y, cover, gaps) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([f is not None for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([f for f in found if f is not None], pa.float64())], ["short", "long", "coverage"])

    return both.select("short", "long", "x", "y").mapInArrow(verify, f"short {id_type}, long {id_type}, coverage double")
