"""Quality rules whose cutoffs carry a guarantee against false rejection.

Base statistics of every whole text give three rule metrics (parts per
thousand): symbols among word characters, repeated lines, repeated words.  A
ladder of ``LEVELS`` settings makes all rules stricter step by step.  On
labelled good documents, per stratum, the false rejections of each setting
are bounded from above by an exact (Clopper-Pearson) binomial bound.  The
settings of a stratum are tested from loose to strict, stopping at the first
whose bound exceeds ``alpha``: a fixed sequence of tests holds its level
without a correction, and Bonferroni's correction over the strata holds all
bounds at once with confidence 1 - delta.  Where the labels cannot guarantee
any setting, no document of the stratum is rejected by it.

The bound needs independent draws, so a labelled document counts once, however
often its id or its text is given.  It covers the documents that pass the base
rule; what the base rule rejects is not part of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pieces, text_buffers
from ..plans.scratch import materialize
from .wordhash import SPACE, run_hashes, word_hashes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 5
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs from loose to strict: symbols, repeated lines, repeated words, each per thousand.
LEVELS = [(round(500 * 0.8**i), round(900 * 0.93**i), round(200 * 0.96**i)) for i in range(18)]


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of every text."""
    buf, offsets = text_buffers(column)
    starts, ends, first = words(buf, offsets)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])

    out = {"n_words": np.diff(first), "word_chars": total(~SPACE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[buf])}
    runs = run_hashes(word_hashes(buf, starts, ends), WINDOW)
    owner = np.repeat(np.arange(len(first) - 1), out["n_words"])
    at = np.flatnonzero(np.repeat(first[1:], out["n_words"])[: len(runs)] - np.arange(len(runs)) >= WINDOW)
    order = np.lexsort((runs[at], owner[at]))
    sorted_at = at[order]
    same = (runs[sorted_at[1:]] == runs[sorted_at[:-1]]) & (owner[sorted_at[1:]] == owner[sorted_at[:-1]])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(first[-1] + 1, np.int64)
    np.add.at(edge, sorted_at[twice], 1)
    np.add.at(edge, sorted_at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    out["n_repeat_words"] = np.diff(covered[first])
    lines, again = [], []
    for text in column.cast(pa.binary()):
        full = [x for x in (text.as_py() or b"").split(b"\n") if x and not x.isspace()]
        lines.append(len(full))
        again.append(len(full) - len(set(full)))
    return out | {"n_lines": np.array(lines, np.int64), "n_dup_lines": np.array(again, np.int64)}


def upper_bound(errors: int, n: int, risk: float) -> float:
    """The largest error rate under which ``errors`` or fewer of ``n`` have a probability of at least ``risk``."""
    if errors >= n:
        return 1.0
    x = np.arange(errors + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in x])
    low, high = errors / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = logs + x * math.log(p) + (n - x) * math.log1p(-p) if 0 < p < 1 else np.array([-math.inf])
        if np.exp(terms).sum() >= risk:
            low = p
        else:
            high = p
    return high


def choose_levels(tally: DataFrame, alpha: float, delta: float) -> DataFrame:
    """For each stratum the number of the strictest setting whose bound is at most ``alpha`` (-1: none).

    ``tally`` has stratum, level (the first setting that rejects, or the
    number of settings) and n (labelled good documents).
    """
    risk = delta / max(1, tally.select("stratum").distinct().count())

    def pick(table: pa.Table) -> pa.Table:
        counts = np.zeros(len(LEVELS) + 1, np.int64)
        np.add.at(counts, np.array(table.column("level")), np.array(table.column("n")))
        n, best = int(counts.sum()), -1
        for i, errors in enumerate(np.cumsum(counts)[:-1].tolist()):
            # past a few times the allowed errors the bound cannot hold
            if errors > alpha * n or upper_bound(errors, n, risk) > alpha:
                break
            best = i
        return pa.table({"stratum": pa.array([table.column("stratum")[0].as_py()]), "cut": pa.array([best], pa.int32())})

    return tally.groupBy("stratum").applyInArrow(pick, "stratum string, cut int")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", key_col: str | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, level, cut, and ``key_col`` if given.

    ``labels`` (id, quality 0/1) may hold an id more than once: it is good if
    all its labels say so; null labels are ignored.  An id or text given more
    than once counts once for the bounds, with the first setting that rejects it.  Null texts have no words
    and fail the base rule; a null stratum is the stratum ''.  Every row of
    ``docs`` gets one result, rows given twice too.  Other columns are ignored.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, 2)):
            c = base_counts(batch.column(2))
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            metrics = (1000 * c["n_symbols"] // np.maximum(c["word_chars"], 1), 1000 * c["n_dup_lines"] // np.maximum(c["n_lines"], 1), 1000 * c["n_repeat_words"] // np.maximum(c["n_words"], 1))
            level = np.full(batch.num_rows, len(LEVELS), np.int32)
            for i in range(len(LEVELS) - 1, -1, -1):
                level[np.any([m > cut for m, cut in zip(metrics, LEVELS[i], strict=True)], axis=0)] = i
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), *(pa.array(c[x], pa.int64()) for x in names), pa.array(failed), pa.array(level)], ["id", "stratum", "key", "print", *names, "base_failed", "level"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"), (F.col(key_col) if key_col else F.lit(None)).cast("string").alias("key"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("print"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, stratum string, key string, print string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, level int"
    digest = materialize(rows.mapInArrow(measure, schema), "digest")
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    once = digest.where("not base_failed").join(good, "id", "left_semi").groupBy("stratum", "id").agg(F.min("print").alias("print"), F.min("level").alias("level"))
    tally = once.groupBy("stratum", "print").agg(F.min("level").alias("level")).groupBy("stratum", "level").agg(F.count("*").alias("n"))
    cuts = choose_levels(materialize(tally, "tally"), alpha, delta)
    out = digest.join(cuts, "stratum", "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))
    kept = ~F.col("base_failed") & (F.col("level") > F.col("cut"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum", "level", "cut", *([F.col("key").alias(key_col)] if key_col else []))
