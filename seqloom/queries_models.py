"""Queries over families of sequences: alignments, profiles, search-back.

A part's family is the last word of its name; its sequence is made of the
letters of its name and type, those outside the twenty residues replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import align, text
from .operators import collapse, models, seeds
from .plans.scratch import materialize
from .queries import query, table

FOREIGN, OWN = "BJOUXZ", "DIKCAE"


def _members(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.upper(F.regexp_extract("p_name", r"(\w+)$", 1)).alias("family"), F.col("p_partkey").alias("member"), F.translate(text.letters(F.concat("p_name", "p_type")), FOREIGN, OWN).alias("sequence"))


def _models(members: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    shares = models.background(members, "sequence")
    aligned = materialize(models.align_families(members, "family", "member", "sequence"), "rows")
    return materialize(models.estimate(aligned, "family", "member", shares), "models"), shares


@query()
def family_alignment(spark, d):
    aligned = models.align_families(_members(spark, d), "family", "member", "sequence")
    return models.column_counts(models.cells(aligned, "family", "member"))


@query()
def family_profiles(spark, d):
    members = _members(spark, d)
    built, shares = _models(members)
    heights = models.emission_rows(built, "family")
    return heights.withColumn("p", F.round("p", 9))


@query()
def family_search(spark, d):
    members = _members(spark, d)
    built, shares = _models(members)
    hits = models.search_back(built, members, "family", "member", "sequence", shares)
    return hits.withColumns({c: F.round(c, 6) for c in ("score", "forward")})


@query()
def family_manifest(spark, d):
    members = _members(spark, d)
    built, shares = _models(members)
    hits = materialize(models.search_back(built, members, "family", "member", "sequence", shares), "hits")
    sizes = members.groupBy("family").agg(F.count("*").alias("n_members"))
    summary = collapse.domain_summary(hits, "family", "member", sizes.withColumnRenamed("n_members", "n"), models.FLOOR)
    return models.manifest(hits, sizes, "family").join(summary.select("family", F.round("least", 4).alias("min_hmm_coverage")), "family")


# --- candidates ------------------------------------------------------------------------------------------------------


def _nodes(spark, d) -> DataFrame:
    """The distinct sequences of the parts, by their least part."""
    return _members(spark, d).groupBy("sequence").agg(F.min("member").alias("node"))


@query()
def remote_alignment(spark, d):
    n = materialize(_nodes(spark, d), "nodes")
    pairs = seeds.seeded_pairs(n, "node", "sequence", hits=1)
    a, b = (n.select(F.col("node").alias(k), F.col("sequence").alias(f"s{k}")) for k in "ab")
    hits = align.align_pairs(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b"), "a", "b", "sa", "sb", 10_000)
    raw = F.round((F.col("bits") * F.log(F.lit(2.0)) + F.log(F.lit(align.K))) / align.LAMBDA).cast("long")
    return hits.select("a", "b", F.round("pct_id", 6).alias("pct_id"), raw.alias("score"), F.round("qcov", 6).alias("qcov"), F.round("scov", 6).alias("scov"))


@query()
def near_contained_parts(spark, d):
    pairs = seeds.near_contained_pairs(materialize(_nodes(spark, d), "nodes"), "node", "sequence")
    return pairs.withColumn("coverage", F.round("coverage", 9))
