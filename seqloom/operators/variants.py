"""Groups of sequences that contain one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .components import components
from .relate import containment_place


def substring_groups(rows: DataFrame, node: str, text: str, links: DataFrame, short: str, long: str) -> DataFrame:
    """(group, node, role, delta, place): the shortest text of each group is its core, the others contain it or a relative."""
    # lengths choose the cores; texts are read for members of groups only
    members = materialize(components(links, short, long).withColumnRenamed("node", node).join(rows.select(node, F.length(text).alias("_length")), node), "members")
    core = members.groupBy("root").agg(F.min(F.struct("_length", F.col(node).alias("node"))).alias("_core")).select("root", F.col("_core.node").alias("_node"))
    cores = core.join(rows.select(F.col(node).alias("_node"), F.col(text).alias("_text")), "_node").select("root", F.struct(F.col("_node").alias("node"), F.col("_text").alias("text")).alias("core"))
    joined = rows.select(node, text).join(members.select(node, "root"), node).join(cores, "root")
    role = F.when(F.col(node) == F.col("core.node"), "core").otherwise("superset")
    place = F.when(role == "core", "core").otherwise(F.when(F.col(text).contains(F.col("core.text")), containment_place(F.col("core.text"), F.col(text))).otherwise("chain"))
    return joined.select(F.col("core.node").alias("group"), node, role.alias("role"), (F.length(text) - F.length("core.text")).alias("delta"), place.alias("place"))


def collapse_to_wildtype(groups: DataFrame, group: str, node: str, wildtype: str) -> DataFrame:
    """(node, target): groups with exactly one wild type collapse onto it, others stay as they are."""
    counts = groups.groupBy(group).agg(F.count_if(F.col(wildtype)).alias("_n_wt"), F.min(F.when(F.col(wildtype), F.col(node))).alias("_wt"))
    joined = groups.join(counts, group)
    return joined.select(node, F.when(F.col("_n_wt") == 1, F.col("_wt")).otherwise(F.col(node)).alias("target"), F.when(F.col("_n_wt") == 1, F.when(F.col(node) == F.col("_wt"), "wildtype").otherwise("collapsed")).when(F.col("_n_wt") == 0, "no_wildtype").otherwise("ambiguous").alias("status"))


def collapse_pairs(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Rows named in a fixed list (drop, keep) take the kept row's key."""
    return rows.join(pairs.select(F.col("drop").alias(key), F.col("keep").alias("_keep")), key, "left").withColumn("target", F.coalesce("_keep", key)).drop("_keep")
