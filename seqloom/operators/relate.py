"""Joins: rank-matched, claiming, cascading, overlaying and containment joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows
from ..plans.scratch import materialize
from ..sources.delimited import numbered


def ranked(df: DataFrame, key: str, order: list, name: str = "_rank") -> DataFrame:
    """The place, from 1, of each row among those of its key.

    Rows are numbered over a range-partitioned sort and each key's first number
    is taken off, so a key with very many rows is spread over tasks.
    """
    placed = numbered(df, key, *order, name="_at")
    first = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"))
    joined = placed.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_key", "_first")


def rank_match(left: DataFrame, right: DataFrame, key: str, left_order: list, right_order: list) -> DataFrame:
    """The k-th left row of a key meets the k-th right row of it; columns other than the key must differ.

    ``source``: 'both' where the key is on both sides (also for surplus left
    rows, which find no partner), 'left', or 'right' for right rows left over.
    Blank and null keys match nothing.
    """
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    a, b = ranked(left.where(~blank), key, left_order), ranked(right.where(~blank), key, right_order)
    known = right.where(~blank).select(key).distinct().withColumn("_known", F.lit(True))
    matched = a.join(b, [key, "_rank"], "full").join(known, key, "left")
    from_left = F.lit(False)
    for c in left.columns:
        if c != key:
            from_left = from_left | F.col(c).isNotNull()
    source = F.when(~from_left, "right").when(F.col("_known"), "both").otherwise("left")
    out = matched.withColumn("source", source).drop("_known")
    rest = left.where(blank).withColumn("source", F.lit("left")).unionByName(right.where(blank).withColumn("source", F.lit("right")), allowMissingColumns=True)
    return out.unionByName(rest, allowMissingColumns=True)


def claim(seeds: DataFrame, rows: DataFrame, key: str, seed_order: list, row_order: list) -> DataFrame:
    """Each seed, in order, claims one row with its key that no other seed has; seeds without a row stay as they are."""
    return ranked(seeds, key, seed_order).join(ranked(rows, key, row_order), [key, "_rank"], "left")


def cascade(base: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str, prefer: Column | None = None) -> DataFrame:
    """The first non-blank value among ordered look-up tables (key, value), and the stage that gave it.

    Of a key's values in one stage that with the greatest ``prefer`` is taken
    (``F.length(value)``: the longest; a struct of a match and the length: a
    match, else the longest), then the least.
    """
    stages = None
    for i, (name, table) in enumerate(sources):
        part = table.where(F.coalesce(F.col(value), F.lit("")) != "")
        if prefer is not None:
            part = part.withColumn("_prefer", prefer)
            best = part.groupBy(key).agg(F.max("_prefer").alias("_most"))
            part = part.join(best, key).where(F.col("_prefer").eqNullSafe(F.col("_most")))
        part = part.groupBy(key).agg(F.min(value).alias(value)).select(key, value, F.lit(i).alias("_stage"), F.lit(name).alias("stage"))
        stages = part if stages is None else stages.unionByName(part)
    best = stages.groupBy(key).agg(F.min_by(F.struct(value, "stage"), "_stage").alias("_best"))
    return base.join(best, key, "left").select(*base.columns, F.coalesce(f"_best.{value}", F.lit("")).alias(value), F.coalesce("_best.stage", F.lit("")).alias("stage"))


def fill_blanks(base: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Only blank cells are filled, so a second run changes nothing."""
    hit = found.select(key, F.col(column).alias("_found"))
    cell = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.coalesce("_found", F.lit(""))).otherwise(F.col(column))
    return base.join(hit, key, "left").withColumn(column, cell).select(base.columns)


def first_value(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The values of each key's first row."""
    return df.groupBy(key).agg(*(F.min_by(v, order).alias(v) for v in values))


def overlay(base: DataFrame, by_first: DataFrame, by_second: DataFrame, first: str, second: list[str] | str, value: str) -> DataFrame:
    """A value by the first key, else by the first of the listed second keys that is known; ``via`` names the way.

    ``by_first`` and ``by_second`` are (key, value) with one row for each key.
    ``second`` names an array column of keys in order.
    """
    a = by_first.select(F.col("key").alias(first), F.col(value).alias("_a"))
    keys = base.select(first, F.posexplode(F.array_distinct(second)).alias("_pos", "_key"))
    b = keys.join(by_second.select(F.col("key").alias("_key"), F.col(value).alias("_b")), "_key").groupBy(first).agg(F.min_by("_b", "_pos").alias("_b"))
    joined = base.join(a, first, "left").join(b, first, "left")
    return joined.withColumn(value, F.coalesce("_a", "_b")).withColumn("via", F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("none")).drop("_a", "_b")


def without_tokens(df: DataFrame, tokens: Column, seeds: DataFrame, seed: str) -> DataFrame:
    """Rows none of whose listed tokens is among the seeds."""
    held = df.withColumn("_id", F.monotonically_increasing_id())
    held = materialize(held, "tokens")
    hit = held.select("_id", F.explode(tokens).alias("_token")).join(seeds.select(F.col(seed).alias("_token")).distinct(), "_token", "left_semi").select("_id").distinct()
    return held.join(hit, "_id", "left_anti").drop("_id")


#: One place in so many may begin a window of a long text.
SAMPLE = windows.SAMPLE
#: The broadcast table of bits, 64 for each text's pieces, is sized for so many texts at most (32 MB); with more it lets more windows through, which the join drops.
BROADCAST_PIECES = 4_000_000


def _table(pieces: DataFrame) -> tuple[np.ndarray, int]:
    """Two bits for each wanted piece and for each hash of a piece's first bytes: 64-bit words, and the logarithm of the number of bits."""
    bits = max(12, (64 * min(pieces.count(), BROADCAST_PIECES) - 1).bit_length())  # at most 28
    wanted = pieces.select(F.explode(F.array_distinct(F.concat(F.array("piece", "other"), "marks"))).alias("h"))
    slots = wanted.select(F.explode(F.array(*(F.shiftrightunsigned(F.shiftleft("h", n), 64 - bits) for n in (0, 28)))).alias("slot"))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    set_bits = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # at most one row for 64 bits
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy().view(np.uint64)
    return words, bits


def _held_pairs(short: DataFrame, long: DataFrame, short_id: str, short_text: str, long_id: str, long_text: str) -> DataFrame:
    """(s_id, l_id, s, l) where the text s is part of the longer text l; see ``containment``."""
    s = short.select(F.col(short_id).alias("s_id"), F.col(short_text).alias("s")).where("s <> ''")
    l = long.select(F.col(long_id).alias("l_id"), F.col(long_text).alias("l")).where("l <> ''")  # noqa: E741
    pieces = materialize(s.mapInArrow(windows.own_windows, f"s_id {s.schema['s_id'].dataType.simpleString()}, {windows.PIECES}"), "pieces")
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # powers of two, and those below GRAM
    sent = s.sparkSession.sparkContext.broadcast(_table(pieces))
    held = l.mapInArrow(windows.held_windows(sizes, sent), f"l_id {l.schema['l_id'].dataType.simpleString()}, l_length long, piece long")
    held = materialize(held, "held")

    # a text is sought if a longer one has its first and a longer one its last window; copies are sought once
    known = ["piece", "other", "s_length"]
    counts = held.groupBy("piece").agg(F.count("*").alias("n"), F.max("l_length").alias("longest"))
    sought = pieces.select(*known).distinct()
    for end in ("piece", "other"):
        sought = sought.join(counts.select(F.col("piece").alias(end), F.col("n").alias(f"n_{end}"), F.col("longest").alias("_longest")), end).where("_longest > s_length").drop("_longest")
    sought = materialize(sought, "sought")
    first = F.col("n_piece") <= F.col("n_other")
    anchors = sought.select(*known, F.when(first, F.col("piece")).otherwise(F.col("other")).alias("anchor"), F.when(first, F.col("other")).otherwise(F.col("piece")).alias("far"))
    near = held.withColumnRenamed("piece", "anchor").join(anchors, "anchor").where("s_length < l_length").drop("anchor", "l_length")
    both = near.join(held.select("l_id", F.col("piece").alias("far")), ["l_id", "far"], "left_semi").drop("far")
    found = materialize(both.join(pieces.select("s_id", *known), known).select("s_id", "l_id").distinct(), "candidates")
    return found.join(s, "s_id").join(l, "l_id").where((F.length("s") < F.length("l")) & F.col("l").contains(F.col("s")))


def _named_ids(short_id: str, long_id: str) -> dict[str, str]:
    return {"s_id": short_id, "l_id": long_id} if short_id != long_id else {"s_id": "short_id", "l_id": "long_id"}


def containment(short: DataFrame, long: DataFrame, short_id: str, short_text: str, long_id: str, long_text: str) -> DataFrame:
    """(short_id, long_id) where a shorter text is part of a longer one.

    Of each text two windows of its bytes are its pieces, of one size, the
    greatest power of two that fits: one begins at the first place of its
    first half, the other at the last place from which it fits.  A place is
    where the hash of the next eight bytes is divisible by ``SAMPLE``, and any
    byte in short texts and those without such a place; so the same bytes have
    the same places, and both windows are in every text that holds this one.
    Texts of less than eight bytes are one window.  Of the longer texts
    those windows are exchanged whose bits a broadcast table of the wanted
    pieces has.  A text whose first or last window no longer text has is in
    nothing; for the others the window that fewer texts have leads to
    candidates, which must have the other window too.  Whole texts are
    compared for these only.  Null and empty texts are in nothing and hold
    nothing.
    """
    return _held_pairs(short, long, short_id, short_text, long_id, long_text).select("s_id", "l_id").distinct().withColumnsRenamed(_named_ids(short_id, long_id))


def containment_places(short: DataFrame, long: DataFrame, short_id: str, short_text: str, long_id: str, long_text: str) -> DataFrame:
    """``containment`` with the place of the shorter text in the longer one and the difference of their lengths."""
    both = _held_pairs(short, long, short_id, short_text, long_id, long_text)
    out = both.select("s_id", "l_id", containment_place(F.col("s"), F.col("l")).alias("place"), (F.length("l") - F.length("s")).cast("long").alias("delta"))
    return out.distinct().withColumnsRenamed(_named_ids(short_id, long_id))


def containment_place(short: Column, long: Column) -> Column:
    return F.when(F.startswith(long, short), "prefix").when(F.endswith(long, short), "suffix").when(F.contains(long, short), "internal").otherwise("near")


def tiers(base: DataFrame, key: str, tables: list[DataFrame]) -> DataFrame:
    """Each row with the columns of several tables that have at most one row for its key; rows without one have nulls."""
    for part in tables:
        base = base.join(part, key, "left")
    return base


def overlap(a: Column, b: Column) -> Column:
    """Sorted common entries of two lists."""
    return F.array_sort(F.array_intersect(a, b))


def candidates(ranked_sources: list[DataFrame], row: str, key: str, order: list, cap: int | None = None) -> DataFrame:
    """Candidates of several sources, the first source winning on equal keys; ``cap`` keeps a report's best k."""
    every = None
    for i, df in enumerate(ranked_sources):
        part = df.withColumn("_source", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    once = every.withColumn("_n", F.row_number().over(Window.partitionBy(row, key).orderBy("_source", *order))).where("_n = 1").drop("_n")
    best = once.withColumn("place", F.row_number().over(Window.partitionBy(row).orderBy(*order, "_source", key)))
    return (best.where(F.col("place") <= cap) if cap else best).drop("_source")
