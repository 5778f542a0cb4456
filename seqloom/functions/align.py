"""Pairwise alignment and text similarity that Spark has no expression for (Arrow-batched functions)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Groups of residues with like properties: the rule of the default scores.
ALIKE = ("ILMV", "FWY", "KRH", "DE", "NQ", "ST", "AG", "C", "P")
GAP_OPEN, GAP_EXTEND = 11, 1
#: The constants of a gapped score's statistics.
LAMBDA, K = 0.267, 0.041


def default_scores() -> dict[str, dict[str, int]]:
    """5 on the diagonal (9 for C, W and P), 1 within a group, -2 otherwise; a published matrix can be given instead."""
    letters = "".join(ALIKE)
    group = {c: i for i, g in enumerate(ALIKE) for c in g}
    return {a: {b: (9 if a in "CWP" else 5) if a == b else 1 if group[a] == group[b] else -2 for b in letters} for a in letters}


def read_scores(text: str) -> dict[str, dict[str, int]]:
    """A substitution matrix in the usual text form."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head = lines[0].split()
    return {row.split()[0]: dict(zip(head, map(int, row.split()[1:]), strict=True)) for row in lines[1:]}


def fill(pairs: np.ndarray, gap_open: int, gap_extend: int, local: bool) -> np.ndarray:
    """Best integer score of an alignment with affine gaps that ends at each place of two sequences.

    ``pairs``: the score of each element of the first with each of the second.
    ``local``: an alignment may begin anywhere; else at the start of either
    sequence, with a free gap before.  Rows are vectorised along the second.
    """
    n, m = pairs.shape
    steps = np.arange(m + 1) * gap_extend
    best = np.zeros((n + 1, m + 1), np.int64)
    down = np.full(m + 1, -(10**12), np.int64)
    for i in range(1, n + 1):
        down = np.maximum(down - gap_extend, best[i - 1] - gap_open - gap_extend)
        row = np.maximum(down, 0) if local else down.copy()
        row[0] = 0
        row[1:] = np.maximum(row[1:], best[i - 1, :-1] + pairs[i - 1])
        # a gap along the row: the running maximum of what a gap can start from
        gap = np.maximum.accumulate(row + steps)
        row[1:] = np.maximum(row[1:], gap[:-1] - steps[1:] - gap_open)
        best[i] = row
    return best


def path(best: np.ndarray, pairs: np.ndarray, end: tuple[int, int], gap_open: int, gap_extend: int, local: bool) -> list[tuple[int, int]]:
    """The columns of the best alignment that ends at ``end``: pairs of places, -1 for a gap.

    Of equal ways a pair comes before a gap in the second sequence, and that
    before a gap in the first; of gaps the shortest.
    """
    (i, j), out = end, []
    while i > 0 and j > 0 and (best[i, j] > 0 or not local):
        here = best[i, j]
        if here == best[i - 1, j - 1] + pairs[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
            continue
        hit = np.flatnonzero(best[:i, j] - gap_open - gap_extend * np.arange(i, 0, -1) == here)
        if len(hit):
            out += [(k, -1) for k in range(i - 1, int(hit[-1]) - 1, -1)]
            i = int(hit[-1])
            continue
        hit = np.flatnonzero(best[i, :j] - gap_open - gap_extend * np.arange(j, 0, -1) == here)
        out += [(-1, k) for k in range(j - 1, int(hit[-1]) - 1, -1)]
        j = int(hit[-1])
    return out[::-1]


def spanning_end(best: np.ndarray) -> tuple[int, int]:
    """Where the best alignment to the end of either sequence ends."""
    n, m = best.shape[0] - 1, best.shape[1] - 1
    return max(((n, int(best[-1].argmax())), (int(best[:, -1].argmax()), m)), key=lambda e: best[e])


class Aligner:
    """Alignment of two sequences with affine gaps."""

    def __init__(self, scores: dict[str, dict[str, int]], gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND):
        self.table = np.full((128, 128), -4, np.int64)
        for a, row in scores.items():
            for b, value in row.items():
                self.table[ord(a), ord(b)] = value
        self.open, self.extend = gap_open, gap_extend

    def _columns(self, a: str, b: str, local: bool) -> tuple[int, int, list[tuple[int, int]]]:
        """Score, identities and columns."""
        x, y = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (a, b))
        if not len(x) or not len(y):
            return 0, 0, []
        pairs = self.table[np.ix_(x, y)]
        best = fill(pairs, self.open, self.extend, local)
        i, j = np.unravel_index(int(best.argmax()), best.shape) if local else spanning_end(best)
        columns = path(best, pairs, (int(i), int(j)), self.open, self.extend, local)
        return int(best[i, j]), sum(p >= 0 and q >= 0 and x[p] == y[q] for p, q in columns), columns

    def local(self, a: str, b: str) -> tuple[int, int, int, int, int, int, int]:
        """Score, identities, alignment length, and the aligned range of each side."""
        score, same, columns = self._columns(a, b, True)
        if not columns:
            return 0, 0, 0, 0, 0, 0, 0
        (i, j), (k, m) = columns[0], columns[-1]  # a local alignment begins and ends with pairs
        return score, int(same), len(columns), i, k + 1, j, m + 1

    def spanning(self, a: str, b: str) -> tuple[int, int, int, int, int]:
        """Near-global alignment: both sequences from a common end to a common end, gaps beyond the ends free.

        Score, identities, aligned columns (end gaps left out), and the residues of each side in them.
        """
        score, same, columns = self._columns(a, b, False)
        return score, int(same), len(columns), sum(p >= 0 for p, _ in columns), sum(q >= 0 for _, q in columns)


def bit_score(raw: float) -> float:
    return (LAMBDA * raw - np.log(K)) / np.log(2)


def e_value(bits: float, query_length: int, database_length: int) -> float:
    """Expected chance hits with this score: the database's length is always a parameter."""
    return float(query_length) * database_length * 2.0**-bits


def align_pairs(pairs: DataFrame, a: str, b: str, seq_a: str, seq_b: str, database_length: int, scores: dict | None = None) -> DataFrame:
    """(a, b, pct_id, evalue, bits, qcov, scov) for each candidate pair of sequences."""
    aligner = Aligner(scores or default_scores())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = (x or "").upper(), (y or "").upper()
                score, same, length, i0, i1, j0, j1 = aligner.local(x, y)
                bits = bit_score(score)
                out.append((100.0 * same / length if length else 0.0, e_value(bits, len(x), database_length), bits, (i1 - i0) / max(len(x), 1), (j1 - j0) / max(len(y), 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in out], pa.float64()) for i in range(5))], ["a", "b", "pct_id", "evalue", "bits", "qcov", "scov"])

    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(seq_a), F.col(seq_b))
    kind = rows.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {rows.schema['b'].dataType.simpleString()}, pct_id double, evalue double, bits double, qcov double, scov double")


def near_global(pairs: DataFrame, a: str, b: str, seq_a: str, seq_b: str, scores: dict | None = None) -> DataFrame:
    """(a, b, pct_id, qcov, scov) of each candidate pair by near-global alignment: identities over columns without end gaps."""
    aligner = Aligner(scores or default_scores())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = (x or "").upper(), (y or "").upper()
                _, same, columns, in_x, in_y = aligner.spanning(x, y)
                out.append((100.0 * same / columns if columns else 0.0, in_x / max(len(x), 1), in_y / max(len(y), 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in out], pa.float64()) for i in range(3))], ["a", "b", "pct_id", "qcov", "scov"])

    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(seq_a), F.col(seq_b))
    return rows.mapInArrow(run, f"a {rows.schema['a'].dataType.simpleString()}, b {rows.schema['b'].dataType.simpleString()}, pct_id double, qcov double, scov double")


def best_reference(hits: DataFrame, query: str, reference: str, least: float, order: str) -> DataFrame:
    """Closed reference: each query's reference with the highest identity of at least ``least``; of equals the first by ``order``."""
    good = hits.where(F.col("pct_id") >= least)
    return good.groupBy(query).agg(F.max_by(F.struct(reference, "pct_id"), F.struct("pct_id", -F.col(order))).alias("x")).select(query, "x.*")


def shared_words(sequences: DataFrame, node: str, sequence: str, k: int = 5, least: int = 2) -> DataFrame:
    """Candidate pairs (a, b, shared) with at least ``least`` common words of k residues."""
    words = sequences.select(F.col(node).alias("node"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(sequence), F.lit(f"(?=(.{{{k}}}))"), 1))).alias("word"))
    left, right = words.withColumnRenamed("node", "a"), words.withColumnRenamed("node", "b")
    return left.join(right, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def all_pairs(sequences: DataFrame, node: str) -> DataFrame:
    """Every pair (a, b), a < b: the candidates that miss none, in number the square of the sequences.

    ``shared_words`` misses pairs without common exact words, as many near 30 %
    identity are (recall not measured).
    """
    nodes = sequences.select(F.col(node).alias("a")).distinct()
    return nodes.crossJoin(nodes.withColumnRenamed("a", "b")).where("a < b")


def identity_class(pct: Column, contained: Column) -> Column:
    return F.when((pct >= 100.0) | contained, "IDENTICAL").when(pct >= 99.0, "NEAR-IDENTICAL").when(pct >= 90.0, "HIGH").when(pct >= 40.0, "HOMOLOG").otherwise("DIVERGENT")


def implied_prefactor(evalue: Column, bits: Column, query_length: Column, database_length: Column) -> Column:
    return evalue * F.pow(F.lit(2.0), bits) / (query_length * database_length)


def search_space_models(hits: DataFrame, letters: float, sequences: float) -> DataFrame:
    """(model, log10_k, spread, place): how evenly each form of search space explains E = K * space * 2 ** -bits.

    ``hits``: evalue (positive), bits, query_length, target_length; ``letters``
    and ``sequences`` are those of the database.  The form with the least
    spread of log10 K comes first.
    """
    m, n, total, count = F.col("query_length"), F.col("target_length"), F.lit(float(letters)), F.lit(float(sequences))
    space = {"const": F.lit(1.0), "m(query)": m, "n(target)": n, "m*n": m * n, "m*N": m * total, "N": total, "m*Ndb": m * count, "N*Ndb": total * count, "m*N*Ndb": m * total * count}
    base = F.log10("evalue") + F.col("bits") * F.log10(F.lit(2.0))
    rows = hits.where("evalue > 0").select(F.explode(F.array(*(F.struct(F.lit(k).alias("model"), (base - F.log10(v)).alias("x")) for k, v in space.items()))).alias("m")).select("m.*")
    found = rows.groupBy("model").agg(F.avg("x").alias("log10_k"), F.stddev_pop("x").alias("spread"))
    # nine rows
    place = F.row_number().over(Window.orderBy(F.round("spread", 9), "model")).cast("long")
    return found.withColumn("place", place)


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of both texts, without regard to case."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def block_coverage(short: pd.Series, long: pd.Series) -> pd.Series:
    """The share of the shorter text that lies in matching blocks with the longer one."""
    out = []
    for x, y in zip(short, long, strict=True):
        blocks = difflib.SequenceMatcher(None, y or "", x or "", autojunk=False).get_matching_blocks()
        out.append(sum(m.size for m in blocks) / len(x) if x else 0.0)
    return pd.Series(out)
