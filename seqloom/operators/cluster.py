"""Reference-seeded clustering: greedy kernels per connected component, closed then open reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize
from ..sources.delimited import numbered
from .graph import partition


def _kernel(kind: str, cover: float):
    """(node, ord, len) rows and (node, other, cover) links of one component, tagged, to (node, centroid)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["tag"] == 0].sort_values("ord")
        links = pdf[(pdf["tag"] == 1) & (pdf["cover"] >= cover)]
        near: dict[int, dict[int, float]] = {n: {} for n in nodes["node"]}
        for a, b, c in zip(links["node"], links["other"], links["cover"], strict=True):
            if a in near and b in near:
                near[b][a] = max(c, near[b].get(a, 0.0))  # b may stand for a: a is covered
        centroid: dict[int, int] = {}
        order = dict(zip(nodes["node"], nodes["ord"], strict=True))
        if kind == "cover":
            import heapq

            heap = [(-len(near[n]), order[n], n) for n in near]
            heapq.heapify(heap)
            while heap:
                size, at, n = heapq.heappop(heap)
                if n in centroid:
                    continue
                now = sum(1 for m in near[n] if m not in centroid)
                if now != -size:  # stale: fewer are left
                    heapq.heappush(heap, (-now, at, n))
                    continue
                centroid[n] = n
                for m in near[n]:
                    centroid.setdefault(m, n)
        else:
            back: dict[int, dict[int, float]] = {n: {} for n in near}
            for c, ms in near.items():
                for m, v in ms.items():
                    back[m][c] = v
            for n in nodes.sort_values(["len", "ord"], ascending=[False, True])["node"]:
                options = [(-v, order[c], c) for c, v in back[n].items() if centroid.get(c) == c]
                centroid[n] = min(options)[2] if options else n
        return pd.DataFrame({"node": np.array(list(centroid), dtype=np.int64), "centroid": np.array(list(centroid.values()), dtype=np.int64)})

    return run


#: Nodes and links of a component that one task may hold; larger components are clustered in rounds of joins.
KERNEL_ROWS = 200_000
#: A batch of a larger component has links only, as arrays, and may hold so many times as many.
BATCH = 5


def greedy(nodes: DataFrame, links: DataFrame, kind: str = "cover", cover: float = 0.9, kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """(node, centroid).  ``nodes``: node, ord, len (longs); ``links``: node, other, cover: how much of node other covers.

    'cover': the node that covers most uncovered nodes comes next, ties by ord.
    'length': longest first; a node joins the best existing centroid, or becomes one.
    A connected component of the links that pass is clustered in one task if it
    has at most ``kernel_rows`` nodes and links, else in rounds of joins and
    batches; both give the same clusters.  No join sends a table that grows to
    the driver: all sort, but for the list of large components.
    """
    strong = links.where(F.col("cover") >= cover).where("node <> other")
    strong = strong.join(nodes.select("node").hint("merge"), "node", "left_semi").join(nodes.select(F.col("node").alias("other")).hint("merge"), "other", "left_semi")
    strong = materialize(strong.groupBy("node", "other").agg(F.max("cover").alias("cover")), "strong")
    roots = materialize(partition(nodes, "node", strong, "node", "other"), "roots")
    own = nodes.join(roots.hint("merge"), "node").select("root", F.lit(0).alias("tag"), "node", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("cover"), "ord", "len")
    tied = strong.join(roots.hint("merge"), "node").select("root", F.lit(1).alias("tag"), "node", "other", "cover", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("len"))
    every = materialize(own.unionByName(tied), "tagged")
    # a component of one node needs no kernel
    sizes = materialize(every.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    alone = roots.join(sizes.select("root").hint("merge"), "root", "left_anti").select("node", F.col("node").alias("centroid"))
    large = F.broadcast(sizes.where(F.col("n") > kernel_rows).select("root"))  # each stands for more than kernel_rows rows
    several = every.join(large, "root", "left_anti").join(sizes.select("root").hint("merge"), "root")
    out = several.groupBy("root").applyInPandas(_kernel(kind, cover), "node long, centroid long").unionByName(alone)
    if large.isEmpty():
        return out
    rows = every.join(large, "root")
    if kind == "cover":
        return out.unionByName(_cover_rounds(rows.where("tag = 0").select("root", "node", "ord"), rows.where("tag = 1").select("root", "node", "other"), BATCH * kernel_rows))
    return out.unionByName(_length_rounds(rows.where("tag = 0").select("node", "ord", "len"), rows.where("tag = 1").select("node", "other", "cover")))


def _cover_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, centroid) that the greedy order settles before it leaves the batch.

    Rows (node, other, ord, gain, last): all open links of the nodes that come
    up to the place (gain, last).  What others cover only falls, so while the
    next node of the batch is not behind that place, it is next of all.
    """
    import heapq

    nodes, first, head = np.unique(pdf["other"].to_numpy(), return_index=True, return_inverse=True)
    order, gain, last = pdf["ord"].to_numpy()[first], int(pdf["gain"].iloc[0]), int(pdf["last"].iloc[0])
    names, member = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    by_head, by_member = np.argsort(head, kind="stable"), np.argsort(member, kind="stable")
    h_at, m_at = np.searchsorted(head[by_head], np.arange(len(nodes) + 1)), np.searchsorted(member[by_member], np.arange(len(names) + 1))
    members, heads = member[by_head], head[by_member]
    at = np.searchsorted(names, nodes)  # a node's place among the members, if it is one
    itself = np.where((at < len(names)) & (names[np.minimum(at, len(names) - 1)] == nodes), at, -1)
    as_head = np.full(len(names), -1)
    as_head[itself[itself >= 0]] = np.flatnonzero(itself >= 0)
    left, covered, closed = np.diff(h_at), np.zeros(len(names), bool), np.zeros(len(nodes), bool)
    heap = [(-int(n), int(o), int(x), i) for i, (n, o, x) in enumerate(zip(left, order, nodes, strict=True))]
    heapq.heapify(heap)
    found, centroid = [], []
    while heap:
        size, place, name, i = heapq.heappop(heap)
        if closed[i]:
            continue
        now = int(left[i])
        if now < gain or (now == gain and place > last):
            continue  # behind the batch's end: left for a later one
        if now != -size:
            heapq.heappush(heap, (-now, place, name, i))
            continue
        taken = members[h_at[i] : h_at[i + 1]]
        taken = taken[~covered[taken]]
        own = np.append(taken, itself[i]) if itself[i] >= 0 else taken
        found += [np.array([name]), names[taken]]
        centroid += [name] * (1 + len(taken))
        closed[i] = True
        covered[own] = True
        closed[as_head[taken][as_head[taken] >= 0]] = True
        each = m_at[own + 1] - m_at[own]  # the places of all links of the nodes that are covered now
        places = np.arange(each.sum()) + np.repeat(m_at[own] - np.cumsum(each) + each, each)
        np.subtract.at(left, heads[places], 1)
    return pd.DataFrame({"node": np.concatenate(found).astype(np.int64) if found else np.array([], np.int64), "centroid": np.array(centroid, dtype=np.int64)})


def _cover_rounds(nodes: DataFrame, links: DataFrame, batch_links: int) -> DataFrame:
    """Clusters large components in batches: each takes, of every component, the nodes that cover most, up to ``batch_links`` links.

    ``nodes``: root, node, ord; ``links``: root, node, other.  What a node
    covers only falls, so a batch is settled on its own until its next node
    would come behind the first node outside it.  A batch ends between two
    sizes, or within a size too large for it at an ``ord``; a node with more
    links than a batch is taken by a join.  No table is broadcast but that of
    the batches' ends, with one row for each component.
    """
    heads = nodes.select(F.col("node").alias("other"), "ord")
    links, done = materialize(links.select("root", "node", "other").join(heads.hint("merge"), "other"), "links"), None
    while not links.isEmpty():
        gains = materialize(links.groupBy("root", "other", "ord").agg(F.count("*").alias("size")), "gains")
        sizes = gains.groupBy("root", "size").agg(F.count("*").alias("n"))  # few: distinct sizes add up to the links at most
        down = Window.partitionBy("root").orderBy(F.col("size").desc())
        sizes = sizes.withColumns({"held": F.sum(F.col("n") * F.col("size")).over(down), "top": F.row_number().over(down) == 1})
        # all sizes above the first that does not fit; if that is the greatest, the first places of it
        fits = F.col("held") <= batch_links
        ends = sizes.groupBy("root").agg(F.max(F.when(~fits, F.col("size"))).alias("out"), F.max(F.when(F.col("top"), F.struct("size", "n"))).alias("most"))
        part = F.coalesce(F.col("out") == F.col("most.size"), F.lit(False))
        ends = materialize(ends.select("root", part.alias("part"), F.when(part, F.col("out")).otherwise(F.coalesce("out", F.lit(0)) + 1).alias("gain"), F.col("most.n").alias("n")), "sizes")
        cut = gains.join(F.broadcast(ends.where("part")), "root").where("size = gain")
        step = F.greatest(F.floor(F.lit(1000 * batch_links) / (F.max("gain") * F.max("n"))).cast("int"), F.lit(1))
        lasts = cut.groupBy("root").agg(F.min("ord").alias("first"), step.alias("step"), F.percentile_approx("ord", [k / 1000 for k in range(1, 1000)], 10000).alias("places"))
        lasts = lasts.select("root", F.col("first"), F.get("places", F.least("step", F.lit(999)) - 1).alias("place"))
        last = F.when(F.col("gain") > batch_links, F.col("first")).otherwise(F.coalesce("place", F.lit(2**63 - 1)))
        ends = materialize(ends.join(lasts, "root", "left").select("root", "gain", last.alias("last")), "ends")
        chosen = gains.join(F.broadcast(ends), "root").where((F.col("size") > F.col("gain")) | (F.col("size") == F.col("gain")) & (F.col("ord") <= F.col("last")))
        chosen = materialize(chosen.select("other", "size", "gain", "last"), "chosen")
        small = links.join(chosen.where(F.col("size") <= batch_links).drop("size").hint("merge"), "other")
        found = small.groupBy("root").applyInPandas(_cover_batch, "node long, centroid long")
        # a node larger than a batch is the only one of its batch
        huge = chosen.where(F.col("size") > batch_links).select("other")
        found = found.unionByName(links.join(huge.hint("merge"), "other", "left_semi").select("node", F.col("other").alias("centroid"))).unionByName(huge.select(F.col("other").alias("node"), F.col("other").alias("centroid")))
        found = materialize(found, "found")
        done = found if done is None else done.unionByName(found)
        gone = found.select("node").hint("merge")
        used = (links, gains, ends, chosen)
        links = materialize(links.join(gone, "node", "left_anti").join(found.select(F.col("node").alias("other")).hint("merge"), "other", "left_anti"), "links")
        for table in used:
            discard(table)
    rest = nodes.select("node")
    if done is None:
        return rest.select("node", F.col("node").alias("centroid"))
    return done.unionByName(rest.join(done.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("centroid")))


def _length_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Each round decides the nodes all of whose earlier coverers are decided: without a centroid among these they become one."""
    place = F.struct((-F.col("len")).alias("k"), "ord", "node")
    nodes = materialize(nodes.select("node", "ord", place.alias("place")), "nodes")
    before = links.join(nodes.select("node", "place").hint("merge"), "node").join(nodes.select(F.col("node").alias("other"), F.col("ord").alias("other_ord"), F.col("place").alias("other_place")).hint("merge"), "other")
    before = materialize(before.where("other_place < place").select("node", "other", "cover", "other_ord"), "before")
    left, done = nodes.select("node"), None
    while not left.isEmpty():
        waiting = before.join(left.select(F.col("node").alias("other")).hint("merge"), "other", "left_semi").select("node").distinct()
        ready = left.join(waiting.hint("merge"), "node", "left_anti")
        if done is None:
            found = ready.select("node", F.col("node").alias("centroid"))
        else:
            heads = done.where("node = centroid").select(F.col("node").alias("other"))
            best = before.join(ready.hint("merge"), "node", "left_semi").join(heads.hint("merge"), "other", "left_semi").groupBy("node").agg(F.max_by("other", F.struct("cover", -F.col("other_ord"))).alias("best"))
            found = ready.join(best.hint("merge"), "node", "left").select("node", F.coalesce("best", "node").alias("centroid"))
        found = materialize(found, "found")
        done = found if done is None else done.unionByName(found)
        left = materialize(left.join(found.select("node").hint("merge"), "node", "left_anti"), "left")
    return done


def hierarchy(nodes: DataFrame, links: DataFrame, covers: list[float], kind: str = "cover") -> DataFrame:
    """(node, level, centroid): nodes clustered at the first cover, their centroids at the next, and so on.

    Every node is carried forward: at each level it has the centroid of its
    centroid of the level before.
    """
    held, out = nodes.select("node", F.col("node").alias("at")), None
    for level, cover in enumerate(covers):
        heads = nodes.join(held.select(F.col("at").alias("node")).distinct().hint("merge"), "node", "left_semi")
        found = greedy(heads, links, kind, cover).select(F.col("node").alias("at"), "centroid")
        held = materialize(held.join(found.hint("merge"), "at").select("node", F.col("centroid").alias("at")), "level")
        part = held.select("node", F.lit(level).alias("level"), F.col("at").alias("centroid"))
        out = part if out is None else out.unionByName(part)
    return out


def recruit(links: DataFrame, seeds: DataFrame, cover: float = 0.9) -> DataFrame:
    """(node, centroid, cover): each node joins the seed (node, ord) that covers it best; ties go to the earliest seed."""
    s = seeds.select(F.col("node").alias("other"), F.col("ord").alias("seed_ord"))
    best = links.where(F.col("cover") >= cover).join(s.hint("merge"), "other").join(seeds.select("node").hint("merge"), "node", "left_anti")
    return best.groupBy("node").agg(F.max_by(F.struct(F.col("other").alias("centroid"), "cover"), F.struct("cover", -F.col("seed_ord"))).alias("x")).select("node", "x.*")


def seeded(nodes: DataFrame, links: DataFrame, seeds: DataFrame, cover: float = 0.9, kind: str = "cover", redundant: str = "keep") -> DataFrame:
    """(cluster, node, role, origin): closed reference on the seeds, then open reference on the rest.

    Clusters are numbered with the seeds first, in seed order, then new ones in
    input order.  ``redundant``: 'keep' leaves seeds that cover each other as
    they are; 'drop' makes them members of the seed that stands for them.
    """
    anchors = materialize(seeds.select("node", "ord"), "seeds")
    links = materialize(links.where(F.col("cover") >= cover), "strong")
    demoted = None
    if redundant == "drop":
        own = greedy(nodes.join(anchors.select("node").hint("merge"), "node", "left_semi"), links, kind, cover)
        own = materialize(own, "seed_clusters")
        demoted = own.where("node <> centroid")
        anchors = anchors.join(demoted.select("node").hint("merge"), "node", "left_anti")
    joined = materialize(recruit(links, anchors, cover).select("node", "centroid"), "recruited")
    if demoted is not None:
        joined = joined.join(demoted.select("node").hint("merge"), "node", "left_anti").unionByName(demoted.select("node", "centroid"))
    taken = joined.select("node").unionByName(anchors.select("node")).distinct()
    rest = materialize(nodes.join(taken.hint("merge"), "node", "left_anti"), "rest")
    new = greedy(rest, links, kind, cover)
    every = anchors.select("node", F.col("node").alias("centroid")).withColumn("origin", F.lit("seed")).unionByName(joined.withColumn("origin", F.lit("seed"))).unionByName(new.withColumn("origin", F.lit("denovo")))
    every = materialize(every, "clusters")
    heads = every.where("node = centroid").join(anchors.select("node", F.col("ord").alias("seed_ord")).hint("merge"), "node", "left").join(nodes.select("node", "ord").hint("merge"), "node")
    heads = numbered(heads.withColumn("_late", F.col("origin") == "denovo").withColumn("_by", F.coalesce("seed_ord", "ord")), "_late", "_by", "node")
    heads = heads.select(F.col("node").alias("centroid"), (F.col("_ord") + 1).alias("cluster"))
    return every.join(heads.hint("merge"), "centroid").select("cluster", "node", F.when(F.col("node") == F.col("centroid"), "centroid").otherwise("member").alias("role"), "origin")


def rollup(members: DataFrame, cluster: str, label: str, pct: str, role: str = "role") -> DataFrame:
    """One row for each cluster: centroid, size, members by falling identity then label, as lists that line up."""
    parts = F.sort_array(F.collect_list(F.when(F.col(role) != "centroid", F.struct((-F.col(pct)).alias("k"), F.col(label).alias("label"), F.col(pct).alias("pct")))))
    grouped = members.groupBy(cluster).agg(F.max(F.when(F.col(role) == "centroid", F.col(label))).alias("centroid"), F.count("*").alias("size"), parts.alias("m"))
    return grouped.select(cluster, "centroid", "size", F.concat_ws("; ", F.transform("m", lambda m: m["label"].cast("string"))).alias("members"), F.concat_ws("; ", F.transform("m", lambda m: m["pct"].cast("string"))).alias("pcts"))
