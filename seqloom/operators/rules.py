"""Ordered rule tables: the first rule that holds names the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: list[tuple[str, Column]], fallback: str) -> Column:
    """The name of the first rule whose condition holds; a null condition does not hold."""
    out = None
    for name, condition in rules:
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return F.lit(fallback) if out is None else out.otherwise(F.lit(fallback))


def priority(label: Column, order: list[str], missing: int = 99) -> Column:
    """The label's place in a list, from 0."""
    place = F.array_position(F.array(*map(F.lit, order)), label)
    return F.when(place > 0, place - 1).otherwise(F.lit(missing)).cast("int")


def override(label: Column, verdict: Column, known: dict[str, str]) -> Column:
    """A curator's verdict replaces the label where it names one of ``known``."""
    out = None
    for value, name in known.items():
        out = F.when(verdict == value, F.lit(name)) if out is None else out.when(verdict == value, F.lit(name))
    return label if out is None else out.otherwise(label)


def guarded_edits(rows: DataFrame, edits: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced where ``edits`` (key, before, after) apply.

    An edit whose ``before`` differs from the row's value stops the query: the
    table has changed since the edit was written.
    """
    joined = rows.join(edits.select(key, F.col("before").alias("_before"), F.col("after").alias("_after"), F.lit(True).alias("_edit")), key, "left")
    stale = F.col("_edit") & ~F.col("_before").eqNullSafe(F.col(column))
    checked = F.when(stale, F.raise_error(F.concat(F.lit("stale edit for "), F.col(key).cast("string"))).cast(rows.schema[column].dataType)).when(F.col("_edit"), F.col("_after")).otherwise(F.col(column))
    return joined.withColumn(column, checked).select(rows.columns)


# The confidence rules' names, most urgent first, and those that go to review.
CONFIDENCE = ["external_database", "broken_accession", "wrong_molecule", "obsolete_record", "family_conflict", "confirmed", "confirmed_supp", "title_unmapped", "organism_mismatch", "name_supported", "unverifiable_title", "fetch_error"]
REVIEW = ["broken_accession", "wrong_molecule", "provenance_mismatch", "obsolete_record", "family_conflict", "title_unmapped", "organism_mismatch", "external_database", "fetch_error", "unverifiable_title", "unconfirmed"]


def confidence(kind: Column, resolves: Column, is_protein: Column, is_current: Column, name_flag: Column, paper_flag: Column, sequence_flag: Column, organism_flag: Column) -> Column:
    """The confidence label of an accession from its tiers' flags."""
    found = sequence_flag.isin("seq_in_supp", "acc_in_supp")
    conditions = [
        kind.isin("uniprot", "mgnify") & ~resolves,
        ~resolves,
        resolves & ~is_protein,
        resolves & is_protein & ~is_current,
        (name_flag == "family_conflict") & ~found,
        paper_flag == "doi_match",
        found,
        name_flag == "title_unmapped",
        organism_flag == "mismatch",
        name_flag == "concordant",
        name_flag == "uninformative_title",
        paper_flag == "elink_failed",
    ]
    return first_match(list(zip(CONFIDENCE, conditions, strict=True)), "unconfirmed")


def name_label(passed: Column, agreement: Column, uninformative: Column, unmapped: Column, informative: Column) -> Column:
    return first_match(
        [("skipped_tier0", ~passed), ("concordant", agreement == "match"), ("family_conflict", agreement == "conflict"), ("related_family", agreement == "related"), ("generic_title", agreement == "generic"), ("uninformative_title", uninformative), ("title_unmapped", unmapped & informative), ("name_uninformative", ~informative)],
        "indeterminate",
    )


def paper_label(passed: Column, uid: Column, failed: Column, linked: Column, matched: Column) -> Column:
    """``linked`` and ``matched`` are numbers of papers; a failed look-up is never read as an absence."""
    return first_match([("skipped_tier0", ~passed), ("not_linkable", uid.isin("", "0")), ("elink_failed", failed), ("doi_match", matched > 0), ("unlinked", linked == 0)], "no_doi_overlap")


def sequence_label(match: Column, has_sequence: Column, parsed: Column) -> Column:
    return first_match([("seq_in_supp", match == "sequence"), ("acc_in_supp", match == "accession"), ("acc_in_maintext", match == "accession_maintext"), ("no_sequence", ~has_sequence), ("supp_no_match", parsed)], "supp_unavailable")


def organism_label(a: Column, b: Column) -> Column:
    """Two lineages (struct taxid, species, genus; null if unknown)."""
    return first_match(
        [("uncomparable", a.isNull() | b.isNull()), ("exact", a["taxid"] == b["taxid"]), ("same_species", a["species"] == b["species"]), ("same_genus", a["genus"] == b["genus"]), ("mismatch", a["genus"] != b["genus"])],
        "uncomparable",
    )


def remap_label(identity: Column, organism_rank: Column, overlap: Column, self_overlap: Column) -> Column:
    """``identity`` is null where no candidate was found."""
    return first_match([("remap_strong", (identity >= 99.0) & (organism_rank >= 2) & (overlap >= 1)), ("remap_plausible", identity.isNotNull()), ("self_corroborated", self_overlap >= 1)], "remap_none")
