"""Evidence about records: live checks, search hits, papers, authors, coding sequences, replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import block_coverage, fuzzy_ratio
from .rules import first_match


def near_identity(identity: Column, coverage: Column, least_identity: float = 98.0, least_coverage: float = 90.0) -> Column:
    return (identity >= least_identity) & (coverage >= least_coverage)


def live_protein(molecule: Column, status: Column, replaced_by: Column) -> Column:
    """A protein record that is live and not replaced; a blank status counts as live."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return low(molecule).isin("aa", "peptide") & low(status).isin("", "live") & (low(replaced_by) == "")


def hit_rollup(hsps: DataFrame, query: str, subject: str) -> DataFrame:
    """Per query and subject: identity of the best segment by bits, and the summed query spans as coverage, at most 100.

    ``hsps``: identity, bits, q_from, q_to, query_length.  Spans are summed, not merged.
    """
    g = hsps.groupBy(query, subject).agg(F.max_by("identity", F.struct("bits", "identity")).alias("identity"), F.max("bits").alias("bits"), F.sum(F.abs(F.col("q_to") - F.col("q_from")) + 1).alias("_span"), F.max("query_length").alias("_length"))
    return g.select(query, subject, F.round("identity", 1).alias("identity"), "bits", F.round(F.least(F.lit(100.0), 100.0 * F.col("_span") / F.col("_length")), 1).alias("coverage"))


def supplement_index(files: DataFrame, paper: str) -> DataFrame:
    """Per paper: all accessions and sequences of its files, and parsed, main_text_only or unavailable.

    ``files``: kind ('supplement' or 'main'), accessions, sequences (arrays; null: not readable).
    """
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    readable = lambda k: F.count_if((F.col("kind") == k) & F.col("accessions").isNotNull()) > 0
    status = F.when(readable("supplement"), "parsed").when(readable("main"), "main_text_only").otherwise("unavailable")
    return files.groupBy(paper).agg(flat("accessions").alias("accessions"), flat("sequences").alias("sequences"), status.alias("status"))


def sequence_in(sequence: Column, known: Column, least: int = 60) -> Column:
    """Whether a sequence is among those known, or contains or is contained in one, both being long enough."""
    near = F.exists(known, lambda k: (F.length(k) >= least) & (F.length(sequence) >= least) & (F.contains(k, sequence) | F.contains(sequence, k)))
    return F.coalesce((sequence != "") & (F.array_contains(known, sequence) | near), F.lit(False))


def cited_match(rows: DataFrame, row: str) -> DataFrame:
    """One match per row over its papers in order (``pos``): the first by sequence, else the last by accession, else the first in a main text.

    ``rows``: paper, pos, by_sequence, by_accession, by_text (booleans).
    """
    pick = lambda c, f: f(F.when(F.col(c), F.col("pos")))
    g = rows.groupBy(row).agg(pick("by_sequence", F.min).alias("_s"), pick("by_accession", F.max).alias("_a"), pick("by_text", F.min).alias("_t"))
    kind = first_match([("sequence", F.col("_s").isNotNull()), ("accession", F.col("_a").isNotNull()), ("accession_maintext", F.col("_t").isNotNull())], "none")
    at = g.select(row, kind.alias("match_kind"), F.coalesce("_s", "_a", "_t").alias("_pos"))
    return at.join(rows.select(row, F.col("pos").alias("_pos"), "paper"), [row, "_pos"], "left").select(row, "match_kind", "paper")


def author_overlap(papers_a: DataFrame, papers_b: DataFrame, authors: DataFrame, a: str, b: str, paper: str) -> DataFrame:
    """Common surnames of the papers of each a and each b: (a, b, overlap)."""
    names_a = papers_a.join(authors, paper).select(a, "surname").distinct()
    names_b = papers_b.join(authors, paper).select(b, "surname").distinct()
    return names_a.join(names_b, "surname").groupBy(a, b).agg(F.count("*").alias("overlap"))


def surnames(authors: Column) -> Column:
    """First tokens of a list of author names, lower case, each once."""
    return F.array_distinct(F.transform(F.filter(authors, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.lower(F.split_part(F.trim(x), F.lit(" "), F.lit(1)))))


def year(date: Column) -> Column:
    return F.substring(date, 1, 4)


def coding_match(proteins: DataFrame, coding: DataFrame, key: str) -> DataFrame:
    """Whether a protein's coding record was found by id, else by sequence; mismatch, no_cds or unavailable else.

    ``proteins``: key, record, protein_id, sequence; ``coding``: record, protein_id, sequence (of the product).
    """
    by_id = coding.select("record", "protein_id", F.col("sequence").alias("_id_seq")).dropDuplicates(["record", "protein_id"])
    by_seq = coding.select("record", "sequence", F.lit(True).alias("_seq")).distinct()
    known = coding.select("record", F.lit(True).alias("_known")).distinct()
    joined = proteins.join(by_id, ["record", "protein_id"], "left").join(by_seq, ["record", "sequence"], "left").join(known, "record", "left")
    label = first_match([("unavailable", F.coalesce("record", F.lit("")) == ""), ("by_id", F.col("_id_seq") == F.col("sequence")), ("by_sequence", F.col("_seq")), ("mismatch", F.col("_known"))], "no_cds")
    return joined.select(key, label.alias("cds_match"))


def conflicting(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both tables with different values."""
    return a.select(key, F.col(value).alias("a_value")).join(b.select(key, F.col(value).alias("b_value")), key).where("a_value <> b_value")


def replacement(members: DataFrame, row: str, accession: str, current: str, refseq: str, order: str) -> DataFrame:
    """For each row the member to use instead: RefSeq first, else the first that differs from the current one."""
    other = members.where(F.col(accession) != F.col(current))
    return other.groupBy(row).agg(F.min_by(accession, F.struct(~F.col(refseq), F.col(order))).alias("replacement"))


def near_containment(pairs: DataFrame, short: str, long: str, least: float = 0.92) -> DataFrame:
    """Those candidate pairs whose shorter text lies in matching blocks of the longer one for the most part."""
    ordered = pairs.withColumn("_s", F.when(F.length(short) <= F.length(long), F.col(short)).otherwise(F.col(long))).withColumn("_l", F.when(F.length(short) <= F.length(long), F.col(long)).otherwise(F.col(short)))
    return ordered.withColumn("coverage", block_coverage("_s", "_l")).where(F.col("coverage") >= least).drop("_s", "_l")


def change_audit(before: DataFrame, after: DataFrame, key: str, value: str, similarity: bool = False) -> DataFrame:
    """Per key the lengths before and after, and their difference, of cells that changed; with ``similarity`` also the share of matching blocks."""
    joined = before.select(key, F.coalesce(F.col(value), F.lit("")).alias("_b")).join(after.select(key, F.coalesce(F.col(value), F.lit("")).alias("_a")), key)
    more = [F.round(fuzzy_ratio("_b", "_a"), 4).alias("similarity")] if similarity else []
    return joined.where("_a <> _b").select(key, F.length("_b").alias("len_before"), F.length("_a").alias("len_after"), (F.length("_a") - F.length("_b")).alias("delta"), *more)


def fetch_targets(rows: DataFrame, accession: str, sequence: str) -> DataFrame:
    """The accessions of rows without a sequence, each once, sorted."""
    from ..functions.text import cell, letters

    return rows.where((letters(sequence) == "") & (cell(accession) != "")).select(cell(accession).alias(accession)).distinct().orderBy(accession)


def linked(links: DataFrame, node: str, target: str, name: str) -> DataFrame:
    """Targets of one kind of link only, as a sorted list."""
    return links.where(F.col("link_name") == name).groupBy(node).agg(F.array_sort(F.collect_set(target)).alias("targets"))


def chunked(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A chunk number for every ``n`` rows, as for requests in batches."""
    from ..sources.delimited import numbered

    return numbered(df, *order).withColumn("chunk", F.floor(F.col("_ord") / n).cast("long")).drop("_ord")


def collisions(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys that several ids share."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def best_attempt(attempts: DataFrame, key: str, route_order: list[str]) -> DataFrame:
    """The first usable attempt of each key by a fixed order of routes (``ok`` marks usable ones)."""
    place = F.array_position(F.array(*map(F.lit, route_order)), F.col("route"))
    return attempts.where("ok").groupBy(key).agg(F.min_by("route", place).alias("route"))


def windowed_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's share of its group's total."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(group)))
