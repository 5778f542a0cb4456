"""N-gram Jaccard join: components of documents whose shingle sets reach 80 %.

Candidates come from PartEnum signatures (see ``partenum``), so no link
between different texts is lost.  Signatures are counted over all documents
(see ``blocks``); each set keeps those that occur again and that the prefix
filter needs.  Of the sets with one signature, the one whose signatures are
the most frequent is paired with the others: in a group of near copies that is
the original or the copy closest to it.  Only where the partners of one such
centre lie in several components are they looked at again: their features are
counted, and sets of different components meet if they share one of the
rarest features of each, of which linked sets share at least one.  Pages of
one template that do not link share none of these.  Histograms of the
features rule pairs out without reading the sets; every link is verified on
the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import counted, pack, text_buffers, totals, unpacked
from .partenum import DENOMINATOR, NUMERATOR, signatures
from ..operators.components import components
from ..operators.skew import join_hot
from ..plans.scratch import materialize
from .wordhash import mix, run_hashes, word_hashes, words

NODE_BITS = 20
CELLS = 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEYS_PER_BYTE = 0.13


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and the offset of each document's set."""
    buf, offsets = text_buffers(column)
    buf = LOWER[buf]
    starts, ends, first = words(buf, offsets)
    hashes = word_hashes(buf, starts, ends)
    count = np.diff(first)
    runs = run_hashes(hashes, n)
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.repeat(first[1:], count)[: len(runs)] - np.arange(len(runs)) >= n
    at = np.flatnonzero(inside)
    found, whose = [runs[at]], [owner[at]]
    for length in range(1, n):  # shorter documents: the whole sequence is the one shingle
        short = np.flatnonzero(count == length)
        if len(short):
            found.append(run_hashes(hashes, length)[first[short]])
            whose.append(short)
    feature, owner = np.concatenate(found), np.concatenate(whose)
    order = np.lexsort((feature, owner))
    feature, owner = feature[order], owner[order]
    keep = np.ones(len(feature), bool)
    keep[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
    feature, owner = feature[keep], owner[keep]
    return feature, np.searchsorted(owner, np.arange(len(count) + 1))


def distinct_sets(feature: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of its set among the block's distinct sets (-1: empty), and each set's first document."""
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    number = np.full(len(sizes), -1, np.int64)
    if not len(some):
        return number, some
    sums = np.empty(len(some), dtype=[("a", np.uint64), ("b", np.uint64)])
    sums["a"] = np.add.reduceat(mix(feature ^ np.uint64(0x2545F4914F6CDD1D)), offsets[some])
    sums["b"] = np.add.reduceat(mix(feature + np.uint64(0x9E6C63D0876A9A99)), offsets[some]) + sizes[some].astype(np.uint64)
    _, first, inverse = np.unique(sums, return_index=True, return_inverse=True)
    number[some] = inverse
    return number, some[first]


def _subset(feature: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = offsets[rows + 1] - offsets[rows]
    new = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(int(new[-1])) - np.repeat(new[:-1], length) + np.repeat(offsets[rows], length)
    return feature[at], new


def _cells(feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set its features counted by their first byte, up to 255.

    Two sets differ in at least as many features as the sum over all cells of
    the counts' differences.
    """
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets)) * CELLS + (feature >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * CELLS), 255).astype(np.uint8).reshape(n, CELLS)


def _reaches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(x), len(y)) * DENOMINATOR < max(len(x), len(y)) * NUMERATOR:
        return False
    at = np.searchsorted(x, y)
    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return common * DENOMINATOR >= (len(x) + len(y) - common) * NUMERATOR


def fine_bands(largest: int) -> np.ndarray:
    """Least sizes of bands of set sizes, each about three hundredths wide."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1], low[-1] * 103 // 100) + 1)
    return np.array(low, np.int64)


def rare_features(feature: np.ndarray, offsets: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys by which every two linked sets meet, with the set of each, the feature's place in the set's order, and the side.

    All sets' features are put into one order, the rarest first (``times``
    tells how many sets have each).  A set of size a whose partner has at
    least b features shares 4 / 9 (a + b) of them with it, so one of the first
    a - 4 / 9 (a + b) + 1 is shared.  Partners are told apart by bands of
    sizes: a key is a feature and the bands of both sets.  The side tells
    whether the set's own band is the lower (0) or the higher one (1), or both
    are the same (-1).  Features of one set only are left out.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((feature, times, owner))
    place = np.arange(len(feature)) - np.repeat(offsets[:-1], sizes)
    low = fine_bands(int(sizes.max(initial=1)) * 5 // 4 + 1)
    least = -(-sizes * NUMERATOR // DENOMINATOR)
    own, first, last = (np.searchsorted(low, x, side="right") - 1 for x in (sizes, least, sizes * DENOMINATOR // NUMERATOR))
    keys, sets, places, sides = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    mixed, again = mix(feature[order]), times[order] > 1
    for step in range(int((last - first).max(initial=-1)) + 1):
        band = first + step
        partner = np.maximum(low[np.minimum(band, len(low) - 1)], least)
        prefix = np.where(band <= last, sizes - -(-NUMERATOR * (sizes + partner) // (NUMERATOR + DENOMINATOR)) + 1, 0)
        at = np.flatnonzero(again & (place < prefix[owner]))
        who = owner[at]
        both = np.minimum(band, own)[who] * len(low) * 8 + np.maximum(band, own)[who]
        keys.append(mix(mixed[at] + both.astype(np.uint64)))
        sets.append(who)
        places.append(place[at])
        sides.append(np.where(band == own, -1, band < own)[who])
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(places), np.concatenate(sides)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the columns a, b, n, cells, n2, cells2 whose histograms allow a link."""
    for batch in batches:
        keep = [np.zeros(0, bool)]
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x, y = (np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in part.column(i)]).astype(np.int16) for i in (3, 5))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            keep.append(apart * (DENOMINATOR + NUMERATOR) <= (np.array(part.column(2)) + np.array(part.column(4))) * (DENOMINATOR - NUMERATOR))
        keep = pa.array(np.concatenate(keep))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the columns a, b, x, y whose sets x and y reach the threshold."""
    for batch in batches:
        keep = pa.array([_reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, block_bytes: int | None = None) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (the least id that links reach).

    A document's set: its distinct ``n``-word shingles after lower-casing A-Z;
    with fewer words the whole sequence as one.  Null, empty and blank texts
    have an empty set, link with nothing and are their own component.  A null
    id is never the least unless its whole component has none.  Rows given
    twice are equal sets, hence linked.  Other columns are ignored.
    ``block_bytes``: see ``blocks``.
    """
    blocks = pack(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", block_bytes)
    id_type = docs.schema[id_col].dataType.simpleString()

    def keys_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        feature, offsets = shingle_sets(rows.column(1), n)
        _, first = distinct_sets(feature, offsets)
        return np.unique(signatures(*_subset(feature, offsets, first)).keys, return_counts=True)

    found, bits = counted(blocks, keys_of, KEYS_PER_BYTE)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document; the first document of each set that shares a signature carries the set."""
        for batch in batches:
            for block, payload, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                rows = unpacked(payload.as_buffer())
                feature, offsets = shingle_sets(rows.column(1), n)
                number, first = distinct_sets(feature, offsets)
                feature, own = _subset(feature, offsets, first)
                signed = signatures(feature, own)
                keys, place = np.unique(signed.keys, return_inverse=True)
                times = totals(keys, answers, bits)[place]
                # how frequent a set's signatures are on average, in 65536ths of a power of two
                fame = np.bincount(signed.sets, np.log2(times), len(first)) / np.maximum(np.bincount(signed.sets, minlength=len(first)), 1)
                keep = signed.needed(times) & (times > 1)
                order = np.flatnonzero(keep)[np.argsort(signed.sets[keep], kind="stable")]
                edge = np.searchsorted(signed.sets[order], np.arange(len(first) + 1))
                sign, cells = signed.keys[order].view(np.int64), _cells(feature, own)
                columns: list[list] = [[None] * rows.num_rows for _ in range(4)]
                for i, at in enumerate(first.tolist()):
                    if edge[i + 1] > edge[i]:
                        for column, value in zip(columns, (sign[edge[i] : edge[i + 1]], int(fame[i] * 65536), cells[i].tobytes(), feature[own[i] : own[i + 1]].tobytes()), strict=True):
                            column[at] = value
                node = pa.array((block << NODE_BITS) + number, pa.int64(), mask=number < 0)
                types = (pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets), pa.int64()), node, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "n_shingles", "node", "keys", "fame", "cells", "features"])

    schema = f"id {id_type}, n_shingles long, node long, keys array<long>, fame long, cells binary, features binary"
    held = materialize(found.select("block", "payload", "answers").mapInArrow(digest, schema), "sets")
    sets = held.where("keys is not null").withColumnRenamed("n_shingles", "n")

    # the centre of a signature's sets: that with the most frequent signatures; it is paired with the others
    entries = sets.select(F.explode("keys").alias("key"), "node", "n", "fame")
    centres = entries.groupBy("key").agg(F.max(F.struct("fame", "node", "n")).alias("centre"), F.count("*").alias("size")).where("size > 1")
    paired = join_hot(entries, centres.select("key", "centre"), "key").where("node != centre.node")
    pairs = materialize(paired.select(F.col("centre.node").alias("a"), F.col("node").alias("b"), F.col("centre.n").alias("n"), F.col("n").alias("n2")).distinct(), "pairs")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b, n, n2) that link: histograms rule most out, and their whole sets stay where they are."""
        able = pairs.where(F.least("n", "n2") * DENOMINATOR >= F.greatest("n", "n2") * NUMERATOR)
        compared = join_hot(able, sets.select(F.col("node").alias("a"), "cells"), "a").join(sets.select(F.col("node").alias("b"), F.col("cells").alias("cells2")).hint("merge"), "b")
        likely = materialize(compared.select("a", "b", "n", "cells", "n2", "cells2").mapInArrow(_near, "a long, b long"), "likely")
        read = join_hot(likely, sets.select(F.col("node").alias("a"), F.col("features").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("features").alias("y")).hint("merge"), "b")
        return materialize(read.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), name)

    links = linked(pairs, "links")
    roots = materialize(components(links, "a", "b"), "roots")

    def rooted(df: DataFrame, node: str, root: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)).hint("merge"), node, "left").withColumn(root, F.coalesce(root, node))

    # Any two sets with a common signature have the same centre.  Where the partners of one centre lie in several
    # components, those that link meet by a rare feature.
    stars = materialize(rooted(pairs.select("a", "b"), "b", "root"), "stars")
    open_ = stars.groupBy("a").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("a")
    apart = join_hot(stars, open_, "a").groupBy(F.col("b").alias("node")).agg(F.first("root").alias("root"))
    apart = materialize(apart.join(sets.select("node", "n", "features").hint("merge"), "node"), "apart")
    if not apart.isEmpty():
        more = linked(_meeting(apart), "more")
        if not more.isEmpty():
            roots = materialize(components(links.unionByName(more), "a", "b"), "roots")

    # documents without a set match nothing; their keys differ, so that they do not meet in one task
    held = held.select("id", "n_shingles", "node", F.coalesce("node", -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("at"))
    held = materialize(rooted(held, "at", "root").select("id", "n_shingles", F.when(F.col("node").isNotNull(), F.col("root")).alias("root")), "rooted")
    least = held.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = join_hot(held, least, "root", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def _meeting(sets: DataFrame) -> DataFrame:
    """Pairs (a, b, n, n2) of the ``sets`` (node, root, n, features) of different roots that share enough from a rare feature on."""

    def of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        features = rows.column(rows.schema.get_field_index("features"))
        sizes = np.array(rows.column(rows.schema.get_field_index("n")), np.int64)
        return np.frombuffer(b"".join(x.as_buffer() for x in features), np.uint64), np.concatenate([[0], np.cumsum(sizes)])

    found, bits = counted(pack(sets, "features"), lambda rows: np.unique(of(rows)[0], return_counts=True), 0.125, "seen")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch.column(0), batch.column(1), strict=True):
                rows = unpacked(payload.as_buffer())
                feature, offsets = of(rows)
                known, place = np.unique(feature, return_inverse=True)
                keys, who, *at = rare_features(feature, offsets, totals(known, answers, bits)[place])
                columns = [np.array(rows.column(rows.schema.get_field_index(c)), np.int64)[who] for c in ("node", "root", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), *columns, *at)], ["key", "node", "root", "n", "place", "side"])

    entries = materialize(found.select("payload", "seen").mapInArrow(keyed, "key long, node long, root long, n long, place long, side long"), "entries")
    # of two sets of different roots one at least is not of the key's commonest root: a large component is not compared with itself
    by_root = entries.groupBy("key", "root").agg(F.count("*").alias("size"))
    mixed = by_root.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("common"), F.count("*").alias("roots")).where("roots > 1").select("key", "common")
    entries = materialize(join_hot(entries, mixed, "key"), "mixed")
    other = entries.select("key", "side", F.col("node").alias("b"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    one = entries.where("root != common").withColumnRenamed("node", "a").withColumn("side", F.when(F.col("side") < 0, F.col("side")).otherwise(1 - F.col("side")))
    met = one.join(other.hint("merge"), ["key", "side"]).where("root != root2")
    # what both have from here on, if this is the first feature that they share
    met = met.where(F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) * (NUMERATOR + DENOMINATOR) >= (F.col("n") + F.col("n2")) * NUMERATOR)
    ordered = F.col("a") < F.col("b")
    pair = (F.when(ordered, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("n", "n2"), ("n2", "n")))
    return materialize(met.select(*pair).distinct(), "met")
