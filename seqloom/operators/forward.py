"""Results that later runs add to and never renumber: clusters, nodes, look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters
from ..plans.scratch import materialize
from ..sources.delimited import numbered
from .cluster import greedy

FOUND, EMPTY, FAILED = "found", "empty", "failed"


def extend(known: DataFrame | None, nodes: DataFrame, links: DataFrame, cover: float = 0.9, kind: str = "cover") -> DataFrame:
    """(node, centroid, cluster, how): earlier clusters as they are, new nodes in them or in new ones.

    ``known``: node, centroid, cluster of earlier runs, or None; ``nodes``:
    node, ord, len of all; ``links`` as for ``cluster.greedy``.  A new node
    joins the known centroid that covers it best (ties: the lowest cluster);
    the others are clustered among themselves, and their clusters get the next
    numbers by their centroids' ord.  ``how``: kept, joined or new.  Known
    nodes stay even if they are among ``nodes`` no more.
    """
    if known is None:
        fresh, joined, base, kept = nodes, None, 0, None
        inner = links
    else:
        kept = known.select("node", "centroid", "cluster")
        base = kept.agg(F.max("cluster")).first()[0] or 0
        new = nodes.join(kept.select("node").hint("merge"), "node", "left_anti")
        heads = kept.where("node = centroid").select(F.col("node").alias("other"), "cluster")
        inner = materialize(links.where(F.col("cover") >= cover).join(new.select("node").hint("merge"), "node", "left_semi"), "near")
        best = inner.join(heads.hint("merge"), "other")
        best = best.groupBy("node").agg(F.max_by(F.struct("other", "cluster"), F.struct("cover", -F.col("cluster"))).alias("x"))
        joined = materialize(best.select("node", F.col("x.other").alias("centroid"), F.col("x.cluster").alias("cluster")), "joined")
        fresh = materialize(new.join(joined.select("node").hint("merge"), "node", "left_anti"), "fresh")
    found = materialize(greedy(fresh, inner, kind, cover), "found")
    heads = numbered(found.where("node = centroid").select("node").join(fresh.select("node", "ord").hint("merge"), "node"), "ord", "node", name="place")
    made = found.join(heads.select(F.col("node").alias("centroid"), (F.col("place") + base + 1).alias("cluster")).hint("merge"), "centroid").select("node", "centroid", "cluster")
    out = made.withColumn("how", F.lit("new"))
    if known is not None:
        out = kept.withColumn("how", F.lit("kept")).unionByName(joined.withColumn("how", F.lit("joined"))).unionByName(out)
    return materialize(out, "clusters")


def bridges(known: DataFrame, now: DataFrame, links: DataFrame, cover: float = 0.9) -> DataFrame:
    """(node, clusters): new nodes that several earlier centroids cover; the clusters, by number, could be merged but keep their numbers."""
    heads = known.where("node = centroid").select(F.col("node").alias("other"), "cluster")
    new = now.where("how <> 'kept'").select("node")
    near = links.where(F.col("cover") >= cover).join(new, "node", "left_semi").join(heads, "other").groupBy("node").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    return near.where(F.size("clusters") > 1)


def extend_levels(known: DataFrame | None, nodes: DataFrame, links: DataFrame, covers: list[float], kind: str = "cover") -> DataFrame:
    """(node, level, centroid, cluster, how): ``extend`` at the first cover, then of the centroids at the next, and so on.

    ``known``: node, level, centroid, cluster of earlier runs.  Only a level's
    centroids are nodes of the next one; new levels may not be put between.
    """
    out, at = None, nodes
    for level, cover in enumerate(covers):
        before = None if known is None else known.where(F.col("level") == level)
        now = extend(before, at, links, cover, kind)
        part = now.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        at = nodes.join(now.where("node = centroid").select("node").hint("merge"), "node", "left_semi")
    return out.select("node", "level", "centroid", "cluster", "how")


def roster(rows: DataFrame, known: DataFrame, row: str, name: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and for each row its node.

    ``known``: sequence_md5, accession, label of earlier nodes.  Rows match
    nodes by the md5 of their sequences' letters, so the key of a node never
    changes; nodes of new sequences are called by their least name, without
    one by 'file:' and eight digits.  Nodes: sequence_md5, accession, label
    (null for new ones), is_new.  Rows: row, sequence_md5, length, is_new;
    rows without a sequence have none.
    """
    keyed = rows.select(F.col(row).alias("row"), F.trim(F.coalesce(F.col(name), F.lit(""))).alias("name"), letters(sequence).alias("sequence")).where("sequence <> ''").withColumn("sequence_md5", F.md5("sequence"))
    keyed = materialize(keyed, "keyed")
    names = keyed.groupBy("sequence_md5").agg(F.min(F.nullif("name", F.lit(""))).alias("name"))
    new = names.join(known.select("sequence_md5"), "sequence_md5", "left_anti").select("sequence_md5", F.coalesce("name", F.concat(F.lit("file:"), F.substring("sequence_md5", 1, 8))).alias("accession"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("is_new"))
    nodes = materialize(known.select("sequence_md5", "accession", "label", F.lit(False).alias("is_new")).unionByName(new), "nodes")
    placed = keyed.join(nodes.select("sequence_md5", "is_new"), "sequence_md5").select("row", "sequence_md5", F.length("sequence").cast("long").alias("length"), "is_new")
    return nodes, placed.withColumnRenamed("row", row)


def overlaid(rows: DataFrame, curated: DataFrame, key: str, sequence: str) -> DataFrame:
    """Rows with curated sequences in place of their own, and outcome: rescued (had none), revised (had another), same, or own (no curated one)."""
    better = curated.select(key, letters(sequence).alias("_better")).where("_better <> ''").dropDuplicates([key])
    own = letters(sequence)
    joined = rows.withColumn(sequence, own).join(better, key, "left")
    outcome = F.when(F.col("_better").isNull(), "own").when(F.col(sequence) == "", "rescued").when(F.col(sequence) != F.col("_better"), "revised").otherwise("same")
    return joined.withColumn("outcome", outcome).withColumn(sequence, F.coalesce("_better", sequence)).drop("_better")


def agreeing(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys whose rows differ in their label: none, where redundant rows agree."""
    return rows.groupBy(key).agg(F.count_distinct(F.coalesce(F.col(label), F.lit(""))).alias("labels")).where("labels > 1")


# --- look-ups --------------------------------------------------------------------------------------------------------


def lookup_key(key: str) -> Column:
    """24 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(F.col(key), 256), 1, 24)


def looked_up(store: DataFrame | None, keys: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The store (digest, key, status, answer) with the answers for ``keys``; what it knows is not fetched again.

    ``fetch`` takes (key) and gives (key, status, answer), status found, empty
    or failed; keys that it gives no row for are empty.  Misses are kept as
    answers are; failures are no answers, so they are tried again by the next
    call, and replaced if that succeeds.
    """
    wanted = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    if store is not None:
        wanted = wanted.join(store.where(F.col("status") != FAILED).select("key"), "key", "left_anti")
    wanted = materialize(wanted, "wanted")
    answers = fetch(wanted.withColumnRenamed("key", key)).select(F.col(key).alias("key"), "status", "answer")
    # of several answers of one key the first of found, empty, failed counts, and of these the least
    rank = F.struct(F.array_position(F.array(*map(F.lit, (FOUND, EMPTY, FAILED))), F.col("status")).alias("rank"), "status", "answer")
    best = answers.groupBy("key").agg(F.min(rank).alias("a")).select("key", "a.status", "a.answer")
    new = wanted.join(best, "key", "left").select(lookup_key("key").alias("digest"), "key", F.coalesce("status", F.lit(EMPTY)).alias("status"), "answer")
    new = materialize(new, "answers")
    if store is None:
        return new
    return materialize(store.join(new.select("key"), "key", "left_anti").select("digest", "key", "status", "answer").unionByName(new), "store")
