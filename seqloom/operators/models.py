"""Models of sequence families: alignment, profile estimation, search-back.

A family's first ``seeds`` members are aligned along a guide tree; every other
member is placed into the columns of that alignment, so that a family of any
size becomes one table of rows.  Weights, counts and probabilities are sums
over that table.  Members and models meet in chunks of a bounded number of
members, however large a family is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles
from ..functions.align import default_scores
from ..functions.profiles import RESIDUES, TRANSITIONS
from ..plans.scratch import materialize

#: Members of one family that are aligned with each other; their least md5 chooses them.
SEEDS = 60
#: Members of one family that meet their model in one task.
CHUNK = 2000
#: A column with residues in at least this share of the (weighted) members is a match state.
MATCH_SHARE = 0.5
#: How many observations the background and the usual transitions count for.
PRIOR = 4.0
#: The usual transitions, in the order of TRANSITIONS; each state's sum to 1.
USUAL = (0.9, 0.05, 0.05, 0.6, 0.4, 0.6, 0.4)
#: A mean coverage of the members below this is flagged.
FLOOR = 0.5


def by_chunk(members: DataFrame, models: DataFrame, family: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over chunks of a family's members, each with all of its family's ``models`` rows.

    The rows of a family are counted first; its members are dealt over as many
    chunks as that asks for, and only its models are copied.
    """
    sizes = materialize(members.groupBy(family).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks")), "chunks")
    dealt = members.join(sizes, family).withColumn("_chunk", F.pmod(F.xxhash64(*members.columns), F.col("_chunks")).cast("int")).drop("_chunks")
    copied = models.join(sizes, family).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    return dealt.groupBy(family, "_chunk").cogroup(copied.groupBy(family, "_chunk")).applyInArrow(run, schema)


def align_families(members: DataFrame, family: str, member: str, sequence: str, scores: dict | None = None, seeds: int = SEEDS) -> DataFrame:
    """(family, member, row): each member as a row of its family's alignment.

    The ``seeds`` members of least md5 (ties by member) are merged along a
    guide tree of word distances, profile against profile.  The others are
    placed into the columns of that alignment one by one: upper-case letters
    and '-' stand in its columns, lower-case letters between them.  Members
    must be distinct within a family; blank sequences have no row.
    """
    scores = scores or default_scores()
    rows = members.select(F.col(family).alias("family"), F.col(member).alias("member"), F.upper(F.col(sequence)).alias("sequence")).where(F.coalesce("sequence", F.lit("")) != "")
    types = {c: rows.schema[c].dataType.simpleString() for c in ("family", "member")}
    schema = f"family {types['family']}, member {types['member']}, row string"
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.md5("sequence"), "member"))
    first = materialize(rows.withColumn("place", place).where(F.col("place") <= seeds), "seeds")

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return table.select(["family", "member"]).append_column("row", pa.array(profiles.progressive(table.column("sequence").to_pylist(), scores), pa.string()))

    aligned = materialize(first.groupBy("family").applyInArrow(merge, schema), "aligned")

    def put(new: pa.Table, known: pa.Table) -> pa.Table:
        if not new.num_rows or not known.num_rows:
            return new.select(["family", "member"]).append_column("row", pa.array([], pa.string()) if not new.num_rows else new.column("sequence"))
        seen, alignment = {}, known.sort_by("member").column("row").to_pylist()
        for s in new.column("sequence").to_pylist():
            if s not in seen:
                seen[s] = profiles.place(alignment, s, scores)
        return new.select(["family", "member"]).append_column("row", pa.array([seen[s] for s in new.column("sequence").to_pylist()], pa.string()))

    others = rows.join(aligned.select("family", "member").hint("merge"), ["family", "member"], "left_anti")
    placed = by_chunk(others, aligned, "family", put, schema)
    return aligned.unionByName(placed).withColumnsRenamed({"family": family, "member": member})


def cells(aligned: DataFrame, family: str, member: str) -> DataFrame:
    """(family, member, place, letter, column, inside): the letters of alignment rows; ``column`` counts the columns up to and with it."""
    letters = aligned.select(F.col(family).alias("family"), F.col(member).alias("member"), F.posexplode(F.split("row", "")).alias("place", "letter")).where(F.col("letter") != "")
    inside = F.col("letter").rlike("[A-Z-]")
    column = F.sum(inside.cast("int")).over(Window.partitionBy("family", "member").orderBy("place")).cast("int")
    return letters.select("family", "member", "place", "letter", column.alias("column"), inside.alias("inside"))


def column_counts(rows: DataFrame) -> DataFrame:
    """(family, column, residue, n) of an alignment's cells; a gap counts as '-'."""
    return rows.where("inside").groupBy("family", "column", F.col("letter").alias("residue")).agg(F.count("*").alias("n"))


def member_weights(rows: DataFrame) -> DataFrame:
    """(family, member, weight): in each column a residue shares 1 / (distinct residues) among its members; weights average 1 within a family."""
    counts = column_counts(rows).where("residue <> '-'")
    kinds = counts.withColumn("kinds", F.count("*").over(Window.partitionBy("family", "column")))
    shares = rows.where("inside and letter <> '-'").join(kinds.withColumnRenamed("residue", "letter"), ["family", "column", "letter"])
    raw = shares.groupBy("family", "member").agg(F.sum(1 / (F.col("kinds") * F.col("n"))).alias("raw"))
    mean = raw.groupBy("family").agg(F.avg("raw").alias("mean"))
    return raw.join(mean, "family").select("family", "member", (F.col("raw") / F.col("mean")).alias("weight"))


def background(members: DataFrame, sequence: str) -> dict[str, float]:
    """Shares of the twenty residues over all sequences, one observation added to each: twenty numbers."""
    kinds = [F.sum(F.length(F.col(sequence)) - F.length(F.regexp_replace(F.upper(F.col(sequence)), c, ""))).alias(c) for c in RESIDUES]
    found = members.agg(*kinds).first()
    counts = {c: (found[c] or 0) + 1 for c in RESIDUES}
    return {c: n / sum(counts.values()) for c, n in counts.items()}


def estimate(aligned: DataFrame, family: str, member: str, shares: dict[str, float]) -> DataFrame:
    """(family, pos, emissions, transitions): the match states of each family's profile.

    Columns in which the weighted share of residues is ``MATCH_SHARE`` or more
    are match states.  Emissions (by RESIDUES) are weighted counts with PRIOR
    observations of the background ``shares``; transitions (by TRANSITIONS)
    weighted counts with PRIOR observations of the usual ones.  Residues before
    the first or after the last match state of a family count for nothing.  A
    family without such a column has no row.
    """
    rows = materialize(cells(aligned, family, member), "cells")
    weights = materialize(member_weights(rows), "weights")
    weighed = rows.join(weights, ["family", "member"])
    solid = F.sum(F.when(F.col("letter") != "-", F.col("weight")).otherwise(0.0)) / F.sum("weight")
    columns = weighed.where("inside").groupBy("family", "column").agg(solid.alias("solid")).where(F.col("solid") >= MATCH_SHARE - 1e-9)
    states = materialize(columns.select("family", "column", F.row_number().over(Window.partitionBy("family").orderBy("column")).alias("pos")), "states")
    last = states.groupBy("family").agg(F.max("pos").alias("last"))

    known = weighed.join(states.withColumn("inside", F.lit(True)), ["family", "column", "inside"], "left")
    emitted = known.where("pos is not null and letter <> '-'").groupBy("family", "pos").pivot("letter", list(RESIDUES)).agg(F.sum("weight"))
    seen = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in RESIDUES), F.lit(0.0))
    emissions = F.array(*((F.coalesce(F.col(c), F.lit(0.0)) + PRIOR * shares[c]) / (seen + PRIOR) for c in RESIDUES))

    state = F.when(F.col("pos").isNotNull(), F.when(F.col("letter") == "-", "d").otherwise("m")).when(F.col("letter") != "-", "i")
    path = known.withColumn("state", state).where("state is not null")
    by_member = Window.partitionBy("family", "member").orderBy("place")
    steps = path.select("family", "weight", "state", F.coalesce(F.max("pos").over(by_member), F.lit(0)).alias("at"), F.lag("state").over(by_member).alias("before"))
    # a match or delete state moves from the one before it; an insert stays at its own
    steps = steps.select("family", "weight", F.concat("before", "state").alias("step"), (F.col("at") - (F.col("state") != "i").cast("int")).alias("pos")).where(F.col("pos") > 0)
    moved = steps.where(F.col("step").isin(*TRANSITIONS)).join(last, "family").where("pos < last").groupBy("family", "pos").pivot("step", list(TRANSITIONS)).agg(F.sum("weight"))
    own = {t: F.coalesce(F.col(t), F.lit(0.0)) for t in TRANSITIONS}
    total = {s: sum((own[t] for t in TRANSITIONS if t[0] == s), F.lit(0.0)) for s in "mid"}
    transitions = F.array(*((own[t] + PRIOR * u) / (total[t[0]] + PRIOR) for t, u in zip(TRANSITIONS, USUAL, strict=True)))
    out = states.select("family", "pos").join(emitted.select("family", "pos", emissions.alias("emissions")), ["family", "pos"], "left").join(moved.select("family", "pos", transitions.alias("transitions")), ["family", "pos"], "left")
    bare, usual = F.array(*(F.lit(shares[c]) for c in RESIDUES)), F.array(*map(F.lit, USUAL))
    return out.select(F.col("family").alias(family), "pos", F.coalesce("emissions", bare).alias("emissions"), F.coalesce("transitions", usual).alias("transitions"))


def emission_rows(models: DataFrame, family: str) -> DataFrame:
    """(family, pos, residue, p), as ``records.column_heights`` takes them for one family."""
    letters = F.array(*map(F.lit, RESIDUES))
    return models.select(family, "pos", F.explode(F.arrays_zip(letters.alias("residue"), F.col("emissions").alias("p"))).alias("e")).select(family, "pos", "e.residue", "e.p")


def profile_lines(models: DataFrame, family: str) -> DataFrame:
    """(family, pos, value): a text line for each match state, its twenty negative log probabilities, in the form that ``records.profile`` reads."""
    scores = F.transform("emissions", lambda p: F.when(p > 0, F.format_string("%.12f", -F.log(p))).otherwise("*"))
    return models.select(family, "pos", F.concat_ws("  ", F.col("pos").cast("string"), scores).alias("value"))


def search_back(models: DataFrame, members: DataFrame, family: str, member: str, sequence: str, shares: dict[str, float]) -> DataFrame:
    """One row for each member: its best local path through its family's profile.

    (family, member, score, forward, hmm_from, hmm_to, seq_from, seq_to,
    query_length, target_length); scores in bits, places from 1, query_length
    the model's states.  Members of families without a model and blank
    sequences have no row.
    """
    rows = members.select(F.col(family).alias("family"), F.col(member).alias("member"), F.upper(F.col(sequence)).alias("sequence")).where(F.coalesce("sequence", F.lit("")) != "")
    base = np.array([shares[c] for c in RESIDUES])
    kinds = {"score": pa.float64(), "forward": pa.float64(), **dict.fromkeys(("hmm_from", "hmm_to", "seq_from", "seq_to", "query_length", "target_length"), pa.int64())}

    def run(new: pa.Table, model: pa.Table) -> pa.Table:
        if not new.num_rows or not model.num_rows:
            return pa.table({"family": new.column("family").slice(0, 0), "member": new.column("member").slice(0, 0), **{c: pa.array([], t) for c, t in kinds.items()}})
        model = model.sort_by("pos")
        odds, logs = profiles.log_model(np.array(model.column("emissions").to_pylist()), np.array(model.column("transitions").to_pylist()), base)
        names = sorted(set(new.column("sequence").to_pylist()), key=lambda s: (len(s), s))
        step = max(1, 2_000_000 // len(odds))  # sequences that are worked on together
        found: dict[str, tuple] = {}
        for at in range(0, len(names), step):
            some = names[at : at + step]
            out = profiles.search(odds, logs, some)
            found |= {s: (*(out[c][i].item() for c in list(kinds)[:6]), len(odds), len(s)) for i, s in enumerate(some)}
        hits = [found[s] for s in new.column("sequence").to_pylist()]
        return pa.table({"family": new.column("family"), "member": new.column("member"), **{c: pa.array([h[i] for h in hits], t) for i, (c, t) in enumerate(kinds.items())}})

    schema = f"family {rows.schema['family'].dataType.simpleString()}, member {rows.schema['member'].dataType.simpleString()}, score double, forward double, hmm_from long, hmm_to long, seq_from long, seq_to long, query_length long, target_length long"
    return by_chunk(rows, models.withColumnRenamed(family, "family"), "family", run, schema).withColumnsRenamed({"family": family, "member": member})


def manifest(hits: DataFrame, sizes: DataFrame, family: str, least: Column | float = 0.0, floor: float = FLOOR) -> DataFrame:
    """Per family: members, model length, detected members, mean and least share of them on the best path, mean share of the model, and flags.

    ``sizes``: family, n_members.  A member is detected from ``least`` bits on.
    Flags, joined by ';': undetected=<number>, low_member_coverage (mean below
    ``floor``), singleton_model.
    """
    own = (F.col("seq_to") - F.col("seq_from") + 1) / F.col("target_length")
    model = (F.col("hmm_to") - F.col("hmm_from") + 1) / F.col("query_length")
    found = hits.where(F.col("score") >= least).groupBy(family).agg(F.count("*").alias("n_detected"), F.avg(own).alias("own"), F.avg(model).alias("model"), F.min(own).alias("low"))
    lengths = hits.groupBy(family).agg(F.max("query_length").alias("hmm_length"))
    joined = sizes.join(lengths, family, "left").join(found, family, "left")
    filled = joined.select(family, "n_members", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hmm_length", "n_detected")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("own", "model", "low")))
    flags = F.concat_ws(";", F.when(F.col("n_detected") < F.col("n_members"), F.concat(F.lit("undetected="), (F.col("n_members") - F.col("n_detected")).cast("string"))), F.when(F.col("own") < floor, "low_member_coverage"), F.when(F.col("n_members") == 1, "singleton_model"))
    return filled.select(family, "n_members", "hmm_length", "n_detected", F.round("own", 4).alias("mean_member_coverage"), F.round("model", 4).alias("mean_hmm_coverage"), F.round("low", 4).alias("min_member_coverage"), flags.alias("flags"))
