"""Comparison of partitions and of edge sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crosstab(a: DataFrame, b: DataFrame, node: str, la: str, lb: str) -> DataFrame:
    """(la, lb, n) over the nodes of both partitions."""
    return a.select(node, la).join(b.select(node, lb), node).groupBy(la, lb).agg(F.count("*").alias("n"))


def _pairs(n: str | Column) -> Column:
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    return n * (n - 1) / 2


def agreement(table: DataFrame, la: str, lb: str) -> DataFrame:
    """Pairs of nodes together in both, in one, in the other; Rand and adjusted Rand index, from counts only."""
    # all four sums in one pass over the crosstab
    sums = table.groupingSets([[la, lb], [la], [lb], []], la, lb).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    part = lambda g: F.sum(F.when(F.col("g") == g, _pairs("n")))
    joined = sums.agg(part(0).alias("both"), part(1).alias("in_a"), part(2).alias("in_b"), F.sum(F.when(F.col("g") == 3, F.col("n"))).alias("nodes")).withColumn("pairs", _pairs("nodes"))
    expected = F.col("in_a") * F.col("in_b") / F.col("pairs")
    top = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected))
    return joined.select(F.col("nodes"), F.col("both").cast("long").alias("both"), (F.col("in_a") - F.col("both")).cast("long").alias("a_only"), (F.col("in_b") - F.col("both")).cast("long").alias("b_only"), F.round((F.col("pairs") + 2 * F.col("both") - F.col("in_a") - F.col("in_b")) / F.col("pairs"), 6).alias("rand"), F.round(ari, 6).alias("ari"))


def dominant(table: DataFrame, la: str, lb: str) -> DataFrame:
    """For each group of the first partition the group that it shares most nodes with; ties go to the larger, then the least."""
    size_b = table.groupBy(lb).agg(F.sum("n").alias("_size"))
    ranked = table.join(size_b, lb).withColumn("_key", F.struct(-F.col("n"), -F.col("_size"), F.col(lb)))
    return ranked.groupBy(la).agg(F.min_by(F.struct(F.col(lb), F.col("n")), "_key").alias("x"), F.sum("n").alias("size"), F.count("*").alias("n_partners")).select(la, F.col(f"x.{lb}").alias(lb), F.col("x.n").alias("shared"), "size", "n_partners")


def changes(table: DataFrame, la: str, lb: str) -> DataFrame:
    """What becomes of each group of the first partition: kept, split, absorbed, or both of these."""
    per_a = table.groupBy(la).agg(F.count("*").alias("targets"), F.sum("n").alias("size"))
    per_b = table.groupBy(lb).agg(F.count("*").alias("sources"))
    joined = table.join(per_a, la).join(per_b, lb).groupBy(la).agg(F.max("targets").alias("targets"), F.max("sources").alias("sources"), F.max("size").alias("size"))
    return joined.withColumn("change", F.when((F.col("targets") == 1) & (F.col("sources") == 1), "kept").when(F.col("targets") == 1, "absorbed").when(F.col("sources") == 1, "split").otherwise("mixed"))


def same_members(a: DataFrame, b: DataFrame, node: str, la: str, lb: str) -> DataFrame:
    """Groups with exactly the same members in both partitions, by counts instead of member lists."""
    table = crosstab(a, b, node, la, lb)
    size_a, size_b = a.groupBy(la).agg(F.count("*").alias("na")), b.groupBy(lb).agg(F.count("*").alias("nb"))
    return table.join(size_a, la).join(size_b, lb).where("n = na and n = nb").select(la, lb, "n")


def presence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Each key of either side with both, a_only or b_only."""
    x, y = a.select(keys).distinct().withColumn("_a", F.lit(1)), b.select(keys).distinct().withColumn("_b", F.lit(1))
    return x.join(y, keys, "full").select(*keys, F.when(F.col("_a").isNull(), "b_only").when(F.col("_b").isNull(), "a_only").otherwise("both").alias("presence"))


def set_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shared, a_only, b_only and the Jaccard index of two key sets."""
    p = presence(a, b, keys)
    counts = p.agg(*(F.count_if(F.col("presence") == n).alias(n) for n in ("both", "a_only", "b_only")))
    return counts.withColumn("jaccard", F.round(F.col("both") / (F.col("both") + F.col("a_only") + F.col("b_only")), 6))
