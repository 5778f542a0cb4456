"""Chat formatting of logged conversations, without their earlier snapshots.

A log may hold the same conversation several times, each time a few turns
longer.  Turns are hashed with their place; a prefix's hash is the sum of its
turns' hashes, so it rolls on from turn to turn.  A conversation whose whole
hash is a prefix hash of a longer one is a snapshot and goes by an anti-join.
Of equal conversations the one with the least id stays.  What is left is
rendered in parts of at most ``PART`` turns, so a conversation of any length
is never gathered in one row or task.

DataFrame functions only: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..sources.delimited import numbered

PART = 256
HEAD, TAIL = "<|im_start|>", "<|im_end|>"


def _half(digest: Column, first: int) -> Column:
    """Twelve hex digits as a number: sums of 2**15 * 2**48 fit a long, sums of more turns fit the decimal."""
    return F.conv(F.substring(digest, first, 12), 16, 10).cast("decimal(20,0)")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each part of each maximal conversation: id, part, n_turns (of the conversation), n_copies, rendered.

    Turns are ordered by number (nulls first), role and text; a number that
    occurs twice counts as two turns.  A null role or text is rendered as an
    empty one, and differs from an empty one for the comparison.  Turns with a
    null conversation are one conversation.  Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # numbered in one order over all tasks, so that no task orders all turns of a conversation; blocks are cut by place
    ordered = numbered(rows, *(F.col(c).asc_nulls_first() for c in ("id", "turn", "role", "text")), name="at")
    starts = ordered.groupBy("id").agg(F.min("at").alias("start")).select(F.col("id").alias("sid"), "start")
    placed = ordered.join(starts, F.col("id").eqNullSafe(F.col("sid"))).withColumn("place", F.col("at") - F.col("start") + 1).withColumn("block", F.floor((F.col("place") - 1) / PART).cast("long"))
    upto = Window.partitionBy("id").orderBy("block")
    known = F.concat(F.coalesce(F.concat(F.lit("r"), F.octet_length("role").cast("string"), F.lit(":"), "role"), F.lit("-")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-")))
    digest = F.sha2(F.concat(F.col("place").cast("string"), F.lit("\n"), known), 256)
    placed = placed.select("id", "block", "place", "role", "text", *(_half(digest, 1 + 12 * i).alias(f"h{i}") for i in range(3)))
    placed = materialize(placed, "turns")

    halves = [f"h{i}" for i in range(3)]
    sums = placed.groupBy("id", "block").agg(*(F.sum(h).alias(f"s{h}") for h in halves))
    sums = sums.select(F.col("id").alias("oid"), F.col("block").alias("oblock"), *((F.sum(f"s{h}").over(upto) - F.col(f"s{h}")).alias(f"b{h}") for h in halves))
    rolling = Window.partitionBy("id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = placed.select("id", "block", "place", *halves).join(sums, F.col("id").eqNullSafe(F.col("oid")) & F.col("block").eqNullSafe(F.col("oblock")))
    prefixes = prefixes.select("id", "place", *((F.sum(h).over(rolling) + F.col(f"b{h}")).cast("decimal(38,0)").alias(h) for h in halves))
    whole = placed.groupBy("id").agg(F.count("*").alias("n_turns"), *(F.sum(h).cast("decimal(38,0)").alias(h) for h in halves))
    # equal conversations first: a popular one is one row from here on
    distinct = whole.groupBy("n_turns", *halves).agg(F.min("id").alias("id"), F.count("*").alias("n_copies"))
    lengths = whole.select(F.col("id").alias("wid"), "n_turns")
    shorter = prefixes.join(lengths, F.col("id").eqNullSafe(F.col("wid"))).where("place < n_turns").select(F.col("place").alias("n_turns"), *halves).distinct()
    maximal = distinct.join(shorter, ["n_turns", *halves], "left_anti").select(F.col("id").alias("mid"), "n_turns", "n_copies")

    turn = F.concat(F.lit(HEAD), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TAIL + "\n"))
    kept = placed.join(maximal, F.col("id").eqNullSafe(F.col("mid"))).withColumn("part", F.floor((F.col("place") - 1) / PART).cast("long"))
    parts = kept.groupBy("id", "part").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("place", turn.alias("said")))).alias("said"))
    return parts.select(F.col("id").alias(conv_col), "part", "n_turns", "n_copies", F.array_join(F.transform("said", lambda s: s["said"]), "").alias("rendered"))

