"""Ordered rule tables over accession strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import first_match
from .text import listed, once, stripped

#: Classes of accessions, tried in this order, without regard to case.
CLASSES = [
    ("refseq", r"^(?:WP|NP|XP|YP|AP|ZP)_\d{6,9}(?:\.\d+)?$"),
    ("refseq_nucleotide", r"^(?:NC|NM|NR|XM|XR|NZ|NT|NW)_\d+(?:\.\d+)?$"),
    ("insd_protein", r"^[A-Z]{3}\d{5}(?:\.\d+)?$"),
    ("wgs_protein", r"^[A-Z]{3}\d{7}(?:\.\d+)?$"),
    ("uniprot", r"^(?:[OPQ]\d[A-Z0-9]{3}\d|[A-NR-Z]\d(?:[A-Z][A-Z0-9]{2}\d){1,2})(?:\.\d+)?$"),
    ("pdb_chain", r"^[0-9][A-Z0-9]{3}_[A-Z0-9]+$"),
    ("pdb_entry", r"^[0-9][A-Z0-9]{3}$"),
    ("mgnify", r"^MGYP\d+$"),
    ("insd_legacy", r"^(?:[A-Z]\d{5}|[A-Z]{2}\d{6})(?:\.\d+)?$"),
]
#: Kinds of identifiers in a list, tried in this order; the rank that each kind sorts by.
KINDS = [
    ("PDB", r"^[0-9][A-Za-z0-9]{3}(_?[A-Za-z](/[A-Za-z])?)?$"),
    ("RefSeq", r"(?i)^(WP|NP|XP|YP|AP)_"),
    ("MGnify", r"(?i)^MGYP"),
    ("UniProt", r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"),
    ("UniProt/locus", r"_"),
    ("GenBank-protein", r"^[A-Z]{3}[0-9]{5,}(\.[0-9]+)?$"),
    ("Nucleotide", r"^[A-Z]{1,2}[0-9]{5,6}(\.[0-9]+)?$"),
    ("Locus", r"(?i)^[A-Z]{2,5}[0-9]{3,4}$"),
]
KIND_RANKS = {"RefSeq": 0, "GenBank-protein": 0, "MGnify": 0, "UniProt": 1, "UniProt/locus": 1, "Nucleotide": 1, "Locus": 1, "PDB": 2}
#: Whether accessions name nucleotides, tried in this order.
MOLECULES = [
    ("^(AC|NC|NG|NM|NR|NT|NW|NZ|XM|XR)_", True),
    ("^MGYP", False),
    ("^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$", False),
    ("^([A-Z][0-9]{5}|[A-Z]{2}[0-9]{6}|[A-Z]{2}[0-9]{8})$", True),
]
PROTEIN_KINDS = ("RefSeq", "GenBank-protein")


def accession_class(x: Column | str) -> Column:
    value = stripped(x)
    return first_match([("missing", value.isin("", "-")), *((name, value.rlike("(?i)" + pattern)) for name, pattern in CLASSES)], "unrecognized")


def has_version(x: Column | str) -> Column:
    return stripped(x).rlike(r"\.\d+$")


def identifier_kind(x: Column | str) -> Column:
    return once(stripped(x), lambda value: first_match([("empty", value == ""), *((name, value.rlike(pattern)) for name, pattern in KINDS)], "UNKNOWN"))


def kind_rank(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(r)) for k, r in KIND_RANKS.items()))


def is_nucleotide(x: Column | str) -> Column:
    """Nucleotide accessions; MGnify and UniProt ids come first and are none."""
    value = F.upper(F.split_part(stripped(x), F.lit("."), F.lit(1)))
    out = None
    for pattern, nucleotide in MOLECULES:
        out = F.when(value.rlike(pattern), nucleotide) if out is None else out.when(value.rlike(pattern), nucleotide)
    return out.otherwise(F.lit(False))


def protein_tokens(x: Column | str) -> Column:
    """The entries of a ';' list that are no nucleotide accessions."""
    return F.filter(listed(x), lambda t: ~is_nucleotide(t))


def dropped_counts(rows: DataFrame, column: str) -> DataFrame:
    """One row: tokens dropped as nucleotides from ';' lists, rows that this empties, rows touched, all rows."""
    n, kept = F.size(listed(column)), F.size(protein_tokens(column))
    return rows.agg(F.sum(n - kept).cast("long").alias("dropped_tokens"), F.count_if((n > 0) & (kept == 0)).alias("emptied_rows"), F.count_if(kept < n).alias("touched_rows"), F.count("*").alias("n_rows"))


def _items(x: Column | str) -> Column:
    """token, kind and rank of each entry of a ';' list."""
    kinds = F.transform(listed(x), lambda t: F.struct(t.alias("token"), identifier_kind(t).alias("kind")))
    ranks = F.create_map(*(F.lit(v) for pair in KIND_RANKS.items() for v in pair))
    return F.transform(kinds, lambda i: F.struct(i["token"].alias("token"), i["kind"].alias("kind"), F.try_element_at(ranks, i["kind"]).alias("rank")))


def order_problems(x: Column | str) -> Column:
    """What is wrong with the order of a ';' list of identifiers."""
    return once(_items(x), _problems)


def _problems(items: Column) -> Column:
    unknown = F.transform(F.filter(items, lambda i: i["kind"] == "UNKNOWN"), lambda i: F.concat(F.lit("unrecognized:"), i["token"]))
    later = lambda known: F.slice(known, F.lit(2), F.greatest(F.size(known) - 1, F.lit(0)))
    steps = once(F.filter(items, lambda i: i["rank"].isNotNull()), lambda known: F.zip_with(F.slice(known, F.lit(1), F.size(later(known))), later(known), lambda a, b: F.when(b["rank"] < a["rank"], F.concat(F.lit("out-of-order:"), b["token"]))))
    protein = F.filter(items, lambda i: i["kind"].isin(*PROTEIN_KINDS))
    misplaced = F.when(~F.get(items, F.lit(0))["kind"].isin(*PROTEIN_KINDS), F.transform(F.slice(protein, 1, 1), lambda i: F.concat(F.lit("primary-misplaced:"), i["token"])))
    return F.concat(unknown, F.filter(steps, lambda s: s.isNotNull()), F.coalesce(misplaced, F.array().cast("array<string>")))


def reordered(x: Column | str) -> Column:
    """A ';' list sorted by rank; equal ranks keep their order, unknown entries their relative place."""
    keyed = lambda items: F.transform(items, lambda t, i: F.struct(F.coalesce(t["rank"].cast("double"), i / F.greatest(F.size(items), F.lit(1))).alias("rank"), i.alias("place"), t["token"].alias("token")))
    return once(_items(x), lambda items: F.concat_ws(";", F.transform(F.array_sort(keyed(items)), lambda k: k["token"])))


def is_refseq(accession: Column | str, source: Column | str) -> Column:
    return stripped(accession).rlike("^(WP|NP|XP|YP)_") | F.lower(F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit(""))).contains("refseq")
