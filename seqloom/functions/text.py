"""Column expressions that normalise text, sequences, accessions and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that stand for a missing accession.
PLACEHOLDERS = ("", "-")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def stripped(x: Column | str) -> Column:
    """Without white space at both ends; null counts as blank."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^\s+|\s+$", "")


def letters(x: Column | str) -> Column:
    """A sequence's letters in upper case; null gives ''."""
    return F.upper(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^A-Za-z]", ""))


def sequence_key(x: Column | str) -> Column:
    """The md5 of the letters; '' for a blank sequence."""
    return F.when(letters(x) == "", F.lit("")).otherwise(F.md5(letters(x)))


def spaceless(x: Column | str) -> Column:
    """Upper case without white space; other symbols stay."""
    return F.upper(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", ""))


def cell(x: Column | str) -> Column:
    """A table cell: stripped, with a lone dash as blank."""
    return F.when(stripped(x).isin(*PLACEHOLDERS), F.lit("")).otherwise(stripped(x))


def digits_only(x: Column | str) -> Column:
    """The number, if the cell is digits only; else null (sorts last)."""
    return F.when(stripped(x).rlike(r"^\d+$"), stripped(x).try_cast("long"))


def first_number(x: Column | str, default: int | None = None) -> Column:
    """The first run of digits as a number; else ``default``."""
    found = F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"(\d+)", 1)
    value = F.when(found != "", found.try_cast("long"))
    return F.coalesce(value, F.lit(default).cast("long"))


def accession_key(x: Column | str) -> Column:
    """Up to the first dot, upper case, a dash as blank."""
    return F.upper(F.split_part(cell(x), F.lit("."), F.lit(1)))


def accession_base(x: Column | str) -> Column:
    return F.split_part(stripped(x), F.lit("."), F.lit(1))


def without_version(x: Column | str) -> Column:
    return F.regexp_replace(stripped(x), r"\.\d+$", "")


def label_token(x: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(stripped(x), r"\s+", "_"), F.lit("")), F.lit("noacc"))


def first_filled(*columns: Column | str) -> Column:
    """The first cell that is not blank; '' if all are."""
    return F.coalesce(*(F.nullif(cell(x), F.lit("")) for x in columns), F.lit(""))


def representative(columns: list[str], listed: str, fallback: str) -> Column:
    """The first filled column, else the least entry of a ';' list, else a prefixed id."""
    least = F.array_min(F.filter(F.transform(F.split(F.coalesce(F.col(listed), F.lit("")), ";"), stripped), lambda t: t != ""))
    return F.coalesce(*(F.nullif(cell(x), F.lit("")) for x in columns), least, F.concat(F.lit("pazy:"), F.col(fallback).cast("string")))


def structure_parts(x: Column | str) -> Column:
    """Entry and chain of a structure id such as 5XFY_A."""
    return F.struct(F.upper(F.regexp_extract(stripped(x), r"^([0-9][A-Za-z0-9]{3})", 1)).alias("entry"), F.regexp_extract(stripped(x), r"^[0-9][A-Za-z0-9]{3}_?([A-Za-z0-9]*)", 1).alias("chain"))


def header_keys(x: Column | str) -> Column:
    """The keys under which a FASTA header's first token can be found."""
    token = F.split_part(stripped(x), F.lit(" "), F.lit(1))
    bar = F.split(token, r"\|")
    entry = F.when((F.get(bar, 0) == "pdb") & (F.size(bar) > 2), F.concat_ws("_", F.get(bar, 1), F.get(bar, 2)))
    return F.array_distinct(F.filter(F.array(token, accession_base(token), F.get(bar, 1), entry), lambda k: k.isNotNull() & (k != "")))


def file_token(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"[^A-Za-z0-9._-]", "_")


def doi(x: Column | str) -> Column:
    """A DOI in lower case without resolver, scheme and closing punctuation."""
    low = F.lower(stripped(x))
    low = F.regexp_replace(low, r"^(https?://)?(dx\.)?doi\.org/", "")
    low = F.regexp_replace(low, r"^doi:\s*", "")
    return F.regexp_replace(F.regexp_replace(low, r"^\s+|\s+$", ""), r"[.;,]+$", "")


#: Fixed value: what separates the DOIs of a cell.
BETWEEN_DOIS = r"[;,]\s*|\s+(?=10\.)"


def dois(x: Column | str) -> Column:
    """The DOIs of a cell that lists them."""
    parts = F.split(F.coalesce(_c(x), F.lit("")), BETWEEN_DOIS)
    return F.filter(F.transform(parts, doi), lambda d: F.startswith(d, F.lit("10.")))


#: Decorations of record titles.
DECORATIONS = (r"(?i)^MULTISPECIES:\s*", r"(?i)^MAG(\s+TPA)?:\s*", r"(?i)^Chain\s+[A-Z0-9]+,\s*", r"(?i)^RecName:\s*Full=", r"(?i);\s*(AltName|Flags|Short)\b.*$", r"\s*;\s*$")


#: Fixed value: the organism in brackets that closes a title.
ORGANISM = r"\[([^\[\]]+)\]\s*$"


def title_parts(x: Column | str) -> Column:
    """A record title without decorations, and the organism in its closing brackets."""
    raw = stripped(x)
    organism = F.regexp_extract(raw, ORGANISM, 1)
    text = F.when(organism != "", F.regexp_replace(raw, r"\s*" + ORGANISM, "")).otherwise(raw)
    for pattern in DECORATIONS:
        text = F.regexp_replace(text, pattern, "")
    return F.struct(stripped(text).alias("title"), stripped(organism).alias("organism"))


def taxon_id(x: Column | str) -> Column:
    """Digits only, '123.0' as 123; '' otherwise."""
    value = F.regexp_replace(stripped(x), r"\.0$", "")
    return F.when(value.rlike(r"^\d+$"), value).otherwise(F.lit(""))


#: Words that say nothing in an enzyme title.
STOPWORDS = (
    "protein family putative probable chain precursor partial multispecies mag recname full flags the of and a isoform variant fragment domain containing type class subunit enzyme gene product unknown function uncharacterized"
).split()


def tokens(x: Column | str, stopwords: list[str] | None = None) -> Column:
    """Distinct lower-case words of letters and digits, without stop words and plain numbers, in order."""
    stop = STOPWORDS if stopwords is None else stopwords
    words = F.split(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+")
    keep = lambda t: (t != "") & ~t.rlike("^[0-9]+$") & (~t.isin(*stop) if stop else F.lit(True))
    return F.array_distinct(F.filter(words, keep))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


#: Fixed value: a purification tag at a sequence's end.
TAG = r"(LE)?H{5,}\*?$"


def without_tag(x: Column | str) -> Column:
    """Without a closing purification tag."""
    return F.regexp_replace(_c(x), TAG, "")


def signed(x: Column | str) -> Column:
    return F.when(_c(x) > 0, F.concat(F.lit("+"), _c(x).cast("string"))).otherwise(_c(x).cast("string"))


def wrapped(x: Column | str, width: int = 60) -> Column:
    return F.regexp_replace(_c(x), f"(.{{{width}}})(?=.)", "$1\n")


def listed(x: Column | str, delimiter: str = ";") -> Column:
    """The non-blank entries of a delimited cell, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), delimiter), stripped), lambda t: t != "")


#: Accessions in running text, of RefSeq, of INSD, of MGnify and of UniProt.
FREE_ACCESSION = r"\b((?:[A-Z]{2}_\d{6,9}|[A-Z]{3}\d{5,7}|MGYP\d{9,}|[OPQ]\d[A-Z0-9]{3}\d|[A-NR-Z]\d[A-Z][A-Z0-9]{2}\d(?:[A-Z][A-Z0-9]{2}\d)?)(?:\.\d+)?)\b"


def free_accessions(x: Column | str) -> Column:
    """Accessions named in running text, each once without its version, article ids left out."""
    text = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"PMC\d+", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FREE_ACCESSION), 1), without_version))


def free_sequences(x: Column | str, least: int = 40) -> Column:
    """Sequences of FASTA records in a text (what precedes the first header counts too), letters only, of at least ``least`` residues."""
    records = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.coalesce(_c(x), F.lit("")), "\r\n?", "\n")), "\n>[^\n]*")
    return F.filter(F.transform(records, letters), lambda s: F.length(s) >= least)


#: Fixed value: the letters and the least length of a sequence in running text.
SEQUENCE = "^[ACDEFGHIKLMNPQRSTVWYXBZUO]{40,}$"


def looks_like_sequence(x: Column | str) -> Column:
    return spaceless(x).rlike(SEQUENCE)


def key_value(x: Column | str, key: str) -> Column:
    """The value of ``key = value`` in a block of text."""
    return F.regexp_extract(F.coalesce(_c(x), F.lit("")), rf"(?m)^\s*{key}\s*=\s*(\S+)", 1)


def file_kind(content: Column | str) -> Column:
    """A file's type by its first bytes."""
    head = F.hex(F.substring(_c(content), 1, 4))
    return F.when(head == "25504446", "pdf").when(F.startswith(head, F.lit("504B")), "zip").when(F.startswith(head, F.lit("D0CF11E0")), "ole").when(F.startswith(head, F.lit("3C")), "markup").otherwise("other")
