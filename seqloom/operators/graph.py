"""Similarity graphs: best pairs, edges, components, numbering, roll-ups, labels against an earlier partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_number
from ..sources.delimited import numbered
from .components import components


def best_pairs(pairs: DataFrame, a: str, b: str, ident: str, evalue: str, bits: str, order: str, rule: str = "max_bits", pct_min: float = 30.0, evalue_max: float = 1e-5) -> DataFrame:
    """One row for each unordered pair: (a, b, pct_id, evalue, bits).

    'max_bits': most bits, then the lower e-value, then the first row;
    'max_identity': the highest identity first; 'any': the best of the rows
    that pass the criterion, if one does.  The criterion is applied after this
    reduction, never before it, but for 'any'.
    """
    rows = pairs.where(F.col(a) != F.col(b))
    if rule == "any":
        rows = rows.where((F.col(ident) >= pct_min) & (F.col(evalue) < evalue_max))
    rank = [F.col(bits), -F.col(evalue), -F.col(order)]
    if rule == "max_identity":
        rank = [F.col(ident), *rank]
    best = F.max_by(F.struct(F.col(ident).alias("pct_id"), F.col(evalue).alias("evalue"), F.col(bits).alias("bits")), F.struct(*rank))
    grouped = rows.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(best.alias("best"))
    return grouped.select("a", "b", "best.*")


def edges(best: DataFrame, pct_min: float = 30.0, evalue_max: float = 1e-5, scale: float = 1.0) -> DataFrame:
    """The edge criterion, on best pairs only; ``scale`` adjusts e-values to another database size."""
    return best.withColumn("evalue", F.col("evalue") * scale).where((F.col("pct_id") >= pct_min) & (F.col("evalue") < evalue_max))


def best_directed(pairs: DataFrame, q: str, s: str, bits: str, order: str, *values: str) -> DataFrame:
    """The best row of each ordered pair by bits; of equals the first."""
    best = pairs.where(F.col(q) != F.col(s)).groupBy(q, s).agg(F.max_by(F.struct(*values, bits), F.struct(F.col(bits), -F.col(order))).alias("x"))
    return best.select(q, s, "x.*")


def best_cover(directed: DataFrame, q: str, s: str) -> DataFrame:
    """For each node and neighbour the greatest (cover, bits, identity) over both directions."""
    there = directed.select(F.col(q).alias("node"), F.col(s).alias("other"), F.struct(F.col("qcov").alias("cover"), "bits", "pct_id").alias("x"))
    back = directed.select(F.col(s).alias("node"), F.col(q).alias("other"), F.struct(F.col("scov").alias("cover"), "bits", "pct_id").alias("x"))
    return there.unionByName(back).groupBy("node", "other").agg(F.max("x").alias("x")).select("node", "other", "x.*")


def partition(nodes: DataFrame, node: str, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node: single linkage, isolated nodes on their own."""
    roots = components(links, a, b).withColumnsRenamed({"node": "_node"})
    return nodes.select(node).distinct().join(roots.hint("merge"), F.col(node) == F.col("_node"), "left").select(node, F.coalesce("root", node).alias("root"))


def canonical_order(label: str, node: str) -> Column:
    """Sort key of a member: first number in its label, label, node."""
    return F.struct(first_number(label, 10**9).alias("n"), F.col(label).alias("label"), F.col(node).alias("node"))


def number_components(members: DataFrame, root: str, label: str, node: str) -> DataFrame:
    """Per component: size, canonical member, id C001... by canonical member, size_rank by size."""
    comps = members.groupBy(root).agg(F.count("*").alias("size"), F.min(canonical_order(label, node)).alias("canonical"))
    by_key = numbered(comps, "canonical", name="_key")
    placed = numbered(by_key, F.col("size").desc(), F.col("canonical"), name="_size")
    number = (F.col("_key") + 1).cast("string")
    return placed.select(root, "size", "canonical", F.concat(F.lit("C"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))).alias("component_id"), (F.col("_size") + 1).alias("size_rank"))


def label_split(members: DataFrame, label: str, component: str) -> DataFrame:
    """Labels found in more than one component."""
    found = members.where(F.coalesce(F.col(label).cast("string"), F.lit("")) != "").groupBy(label).agg(F.array_sort(F.collect_set(component)).alias("components"))
    return found.where(F.size("components") > 1)


def induced(links: DataFrame, nodes: DataFrame, node: str, a: str = "a", b: str = "b") -> DataFrame:
    """Links with both ends among the nodes."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return links.join(n, F.col(a) == F.col("_n"), "left_semi").join(n, F.col(b) == F.col("_n"), "left_semi")


def degrees(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    ends = links.select(F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def inherit_labels(members: DataFrame, component: str, prior: str) -> DataFrame:
    """A name for each component from an earlier partition (null: new node).

    One earlier label that lies nowhere else: inherited.  One that lies in
    several components: split, with a letter by size.  Several: merged, named
    by the least.  None: novel, numbered by component.
    """
    pairs = members.groupBy(component, prior).agg(F.count("*").alias("n"))
    comps = pairs.groupBy(component).agg(F.array_sort(F.collect_set(prior)).alias("labels"), F.sum("n").alias("size"))
    spread = pairs.where(F.col(prior).isNotNull()).groupBy(prior).agg(F.count("*").alias("n_components"))
    single = comps.where(F.size("labels") == 1).withColumn("label", F.get("labels", F.lit(0))).join(spread.withColumnRenamed(prior, "label"), "label")
    letter = F.row_number().over(Window.partitionBy("label").orderBy(F.col("size").desc(), component))
    single = single.withColumn("letter", F.when(letter <= 26, F.char(96 + letter)).otherwise(F.concat(F.lit("z"), letter.cast("string"))))
    single = single.select(component, "size", F.when(F.col("n_components") == 1, "inherited").otherwise("split").alias("kind"), F.when(F.col("n_components") == 1, F.col("label").cast("string")).otherwise(F.concat(F.col("label").cast("string"), F.col("letter"))).alias("name"))
    merged = comps.where(F.size("labels") > 1).select(component, "size", F.lit("merged").alias("kind"), F.concat(F.lit("M"), F.get("labels", F.lit(0)).cast("string")).alias("name"))
    novel = numbered(comps.where(F.size("labels") == 0), component).select(component, "size", F.lit("novel").alias("kind"), F.concat(F.lit("N"), (F.col("_ord") + 1).cast("string")).alias("name"))
    return single.unionByName(merged).unionByName(novel)


def delta_outcome(members: DataFrame, component: str, prior: str) -> DataFrame:
    """For each component with new nodes: novel (no earlier group), merge (two or more), join (one)."""
    c = members.groupBy(component).agg(F.count_if(F.col(prior).isNull()).alias("n_new"), F.count_distinct(prior).alias("n_prior"))
    return c.where("n_new > 0").withColumn("outcome", F.when(F.col("n_prior") == 0, "novel").when(F.col("n_prior") > 1, "merge").otherwise("join"))
