"""Enzyme families named in free text, and how far two sets of them agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import first_match
from .text import once

#: Surface forms of each family.
FORMS = {
    "pet_hydrolase": ["poly(ethylene terephthalate) hydrolase", "pet hydrolase", "petase", "bta-hydrolase", "bta hydrolase", "polyester hydrolase"],
    "cutinase": ["cutinase", "cutin hydrolase"],
    "esterase": ["esterase", "carboxylic ester hydrolase", "alpha/beta fold hydrolase"],
    "lipase": ["lipase", "triacylglycerol acylhydrolase", "lipolytic enzyme"],
    "protease": ["protease", "peptidase", "proteinase", "subtilisin"],
    "amidase": ["amidase", "amido hydrolase", "amidohydrolase"],
    "urethanase": ["urethanase", "urethane hydrolase"],
    "laccase": ["laccase", "multicopper oxidase", "multicopper polyphenol oxidase"],
    "peroxidase": ["peroxidase"],
    "oxidase": ["oxidase", "oxygenase"],
    "dehydrogenase": ["dehydrogenase"],
    "dienelactone_hydrolase": ["dienelactone hydrolase"],
    "depolymerase": ["depolymerase"],
    "nitrilase": ["nitrilase", "nitrile hydratase"],
    "tannase": ["tannase", "tannin acylhydrolase", "feruloyl esterase"],
    "ab_hydrolase": ["alpha/beta hydrolase", "alpha/beta-hydrolase", "ab hydrolase"],
    "mhetase": ["mhetase", "mono(2-hydroxyethyl) terephthalate hydrolase", "mhet hydrolase"],
    "hydrolase": ["hydrolase"],
}
#: Families between which annotations drift, and labels that fit any of them.
CLANS = [
    ["pet_hydrolase", "cutinase", "esterase", "lipase", "mhetase", "dienelactone_hydrolase", "ab_hydrolase", "tannase", "urethanase", "depolymerase", "amidase", "hydrolase"],
    ["protease"],
    ["laccase", "peroxidase", "oxidase", "dehydrogenase"],
    ["nitrilase"],
]
GENERIC = ["ab_hydrolase", "hydrolase"]
#: Families that laboratory codes such as PpCutA, EstB or LCC hint at, as patterns over lower-case names.
CODE_HINTS = [
    (r"petase", "pet_hydrolase"),
    (r"mhetase", "mhetase"),
    (r"\bbta[-_ ]?\d*\b", "pet_hydrolase"),
    (r"\blcc\b|leaf.?compost|leaf.?branch", "cutinase"),
    (r"cut(?:in)?(?:ase)?[a-z]?\d*\b|\bcut\d+", "cutinase"),
    (r"\best(?:erase)?[a-z]?\d*\b", "esterase"),
    (r"lip(?:ase)?[a-z]?\d*\b", "lipase"),
    (r"\bpe[-_]?h\b", "pet_hydrolase"),
    (r"protease|peptidase|subtilisin", "protease"),
    (r"laccase", "laccase"),
    (r"peroxidase", "peroxidase"),
    (r"amidase", "amidase"),
    (r"urethanase", "urethanase"),
    (r"depolymerase", "depolymerase"),
    (r"tannase", "tannase"),
    (r"nitrilase", "nitrilase"),
    (r"\bpet\d*\b|\bpet[a-z]?\b", "pet_hydrolase"),
]
#: Titles that describe no function; characters that separate words.
UNINFORMATIVE = r"(?i)^(?:hypothetical|uncharacterized|unnamed|predicted|putative uncharacterized)\b|^protein of unknown function|^(?:conserved )?(?:hypothetical )?protein\s+\S+$"
SEPARATORS = r"[^a-z0-9()/\- ]+"


def families(text: Column, forms: dict[str, list[str]] = FORMS, weakest: str = "hydrolase") -> Column:
    """Sorted families with a surface form in the text; the weakest only if it is alone.

    A form that contains another of the same family adds nothing, so only the
    shortest are listed.
    """
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "), F.lit(" "))

    def named(words: Column) -> Column:
        flags = []
        for family in sorted(forms):
            hit = F.lit(False)
            for form in forms[family]:
                hit = hit | words.contains(form)
            flags.append(F.when(hit, F.lit(family)))
        return F.filter(F.array(*flags), lambda f: f.isNotNull())

    return once(once(low, named), lambda found: _without_weakest(found, weakest))


def _without_weakest(found: Column, weakest: str) -> Column:
    return F.when(F.size(found) > 1, F.array_remove(found, weakest)).otherwise(found)


def agreement(a: Column, b: Column, clans: list[list[str]] = CLANS, generic: list[str] = GENERIC) -> Column:
    """unknown, match, generic, related or conflict."""
    literal = lambda names: F.array(*map(F.lit, names))
    related = F.lit(False)
    for clan in clans:
        related = related | (F.arrays_overlap(a, literal(clan)) & F.arrays_overlap(b, literal(clan)))
    return first_match(
        [("unknown", (F.size(a) == 0) | (F.size(b) == 0)), ("match", F.arrays_overlap(a, b)), ("generic", F.arrays_overlap(a, literal(generic)) | F.arrays_overlap(b, literal(generic))), ("related", related)],
        "conflict",
    )


def families_of_name(name: Column, weakest: str = "hydrolase") -> Column:
    """Sorted families of an enzyme's name: those in its words, and those that its laboratory code hints at."""
    low = F.lower(F.coalesce(name, F.lit("")))
    hinted = once(low, lambda x: F.filter(F.array(*(F.when(x.rlike(pattern), F.lit(family)) for pattern, family in CODE_HINTS)), lambda f: f.isNotNull()))
    return once(F.array_sort(F.array_union(families(name), hinted)), lambda found: _without_weakest(found, weakest))


def uninformative(title: Column) -> Column:
    """Titles that describe no function."""
    return title.rlike(UNINFORMATIVE)
