"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into m parts of correlated bits.  If a fingerprint
takes thresholds t_1 .. t_m (-1: the part is not looked at) whose sum is
DISTANCE - m + 1, then each fingerprint within DISTANCE bits differs from it
in at most t_i bits of some part i.  Histograms of all distinct fingerprints
tell about how many would be met for each part and threshold, and dynamic
programming chooses the thresholds of least cost for each fingerprint.  It
probes with every variant of a part within the threshold, and meets the
fingerprints indexed by that value.

A value that very many fingerprints share (a large group of near copies) is
not compared as it is: what both sides have left is cut into parts again, in
rounds, until each value has at most ``GROUP`` fingerprints or nine bits are
left, which hold 512 at most.  So comparisons grow with the number of
fingerprints, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.skew import join_hot
from ..plans.scratch import discard, materialize
from .jaccard_join import LOWER
from .wordhash import mix

BITS, DISTANCE, WIDTH, SEED = 64, 2, 3, 42
#: Indexed fingerprints of one value that are compared without cutting further.
GROUP = 256
#: Bits of one histogram: with every part cut into such blocks all histograms have at most 2**18 cells.
BLOCK = 16
#: What one probe costs, in comparisons.
PROBE = 8.0
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 16
ENTRY = "key long, fp long, used long, slack int"


def fingerprint(text: bytes, n: int = WIDTH) -> int:
    """The bits that are set in over half the hashes of the text's n-word shingles, repeats included; zero without a word."""
    import xxhash

    words = text.split()
    if not words:
        return 0
    joined, size = b" ".join(words), [len(w) + 1 for w in words]
    end = np.cumsum(size) - 1
    first = end - np.array(size) + 1
    m = max(1, len(words) - n + 1)
    digest = xxhash.xxh64_intdigest
    last = end[n - 1 :] if len(words) >= n else end[-1:]
    counts = np.zeros(BITS, np.int64)
    spans = list(zip(first[:m].tolist(), last.tolist(), strict=True))
    for at in range(0, m, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + CHUNK]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long."""
    table = LOWER.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_buffer().to_pybytes().translate(table)) if x.is_valid else 0 for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, tally) -> np.ndarray:
    """The sum of ``tally(fps)``, a vector of fixed length, over all fingerprints; only its non-zero cells travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                new = tally(np.array(batch.column(0).slice(at, CHUNK)))
                total = new if total is None else total + new
        if total is not None:
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    found = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.max(found["cell"], initial=-1)) + 1, np.int64)
    out[np.array(found["cell"])] = np.array(found["n"])
    return out


def correlated_parts(fps: DataFrame, m: int) -> list[list[int]]:
    """The 64 bits in m groups of like size: each grows from the bit most correlated with those still free by the bit most correlated with the group."""
    flat = _summed(fps, lambda fp: (lambda x: np.concatenate([[len(x)], (x.T @ x).ravel()]))(_bits(fp).astype(np.int64)))
    flat = np.pad(flat, (0, BITS * BITS + 1 - len(flat)))
    n, both = max(int(flat[0]), 1), flat[1:].reshape(BITS, BITS) / max(int(flat[0]), 1)
    mean = both.diagonal()
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1 / (4 * n * n)))
    close = np.abs(both - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    free, parts = list(range(BITS)), []
    for i in range(m):
        group = [max(free, key=lambda b: (close[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < (i + 1) * BITS // m - i * BITS // m:
            group.append(max(free, key=lambda b: (close[b, group].sum(), -b)))
            free.remove(group[-1])
        parts.append(group)
    return parts


def _blocks(parts: list[list[int]]) -> list[list[list[int]]]:
    return [[p[a : a + BLOCK] for a in range(0, len(p), BLOCK)] for p in parts]


def _values(bits: np.ndarray, chosen: list[int]) -> np.ndarray:
    return bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))


def histograms(fps: DataFrame, parts: list[list[int]]) -> list[list[np.ndarray]]:
    """How many fingerprints have each value of each block of each part."""
    blocks = [b for p in _blocks(parts) for b in p]

    def tally(fp: np.ndarray) -> np.ndarray:
        bits = _bits(fp)
        return np.concatenate([np.bincount(_values(bits, b), minlength=1 << BLOCK) for b in blocks])

    flat = _summed(fps, tally)
    flat = np.pad(flat, (0, (len(blocks) << BLOCK) - len(flat))).reshape(len(blocks), -1)
    found = iter(flat)
    return [[next(found)[: 1 << len(b)] for b in p] for p in _blocks(parts)]


def _around(table: np.ndarray) -> np.ndarray:
    """For each value the sums of the table over values 0, 1 and 2 bits away."""
    at, width = np.arange(len(table)), len(table).bit_length() - 1
    out = np.zeros((DISTANCE + 1, len(table)), np.float64)
    for d in range(DISTANCE + 1):
        for flips in combinations(range(width), d):
            out[d] += table[at ^ sum(1 << b for b in flips)]
    return out


class Plan:
    """Parts, and for each part how many fingerprints are expected 0, 1 and 2 bits from a value."""

    def __init__(self, parts: list[list[int]], tables: list[list[np.ndarray]], total: int):
        self.parts, self.total = parts, max(total, 1)
        self.blocks = _blocks(parts)
        self.near = [[_around(t).astype(np.float32) for t in p] for p in tables]
        self.masks = [_mask(p) for p in parts]

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """(part, threshold + 1, fingerprint): probes and expected comparisons."""
        bits, out = _bits(fp), np.zeros((len(self.parts), DISTANCE + 2, len(fp)))
        for i, (blocks, tables) in enumerate(zip(self.blocks, self.near, strict=True)):
            met = [np.full(len(fp), float(self.total)), *(np.zeros(len(fp)) for _ in range(DISTANCE))]
            for b, t in zip(blocks, tables, strict=True):  # as if the blocks were independent
                here = t[:, _values(bits, b)] / self.total
                met = [sum(met[d - e] * here[e] for e in range(d + 1)) for d in range(DISTANCE + 1)]
            width, probes, seen = len(self.parts[i]), 0.0, np.zeros(len(fp))
            for t in range(DISTANCE + 1):
                probes += (1, width, width * (width - 1) // 2)[t]
                seen = seen + met[t]
                out[i, t + 1] = PROBE * probes + seen
        return out

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprint, part): thresholds of least total cost whose sum is DISTANCE - m + 1."""
        costs, m = self.costs(fp), len(self.parts)
        goal = DISTANCE + 1  # the sum of (threshold + 1)
        best = np.full((m + 1, goal + 1, len(fp)), np.inf)
        took = np.zeros((m, goal + 1, len(fp)), np.int8)
        best[0, 0] = 0
        for i in range(m):
            for s in range(goal + 1):
                for t in range(min(s, DISTANCE + 1) + 1):
                    new = best[i, s - t] + costs[i, t]
                    less = new < best[i + 1, s]
                    best[i + 1, s][less], took[i, s][less] = new[less], t
        out, left = np.zeros((len(fp), m), np.int64), np.full(len(fp), goal)
        for i in reversed(range(m)):
            out[:, i] = took[i, left, np.arange(len(fp))]
            left = left - out[:, i]
        return out - 1


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(fp: np.ndarray, mask: int, base: np.ndarray | None = None) -> np.ndarray:
    """Keys of values of the masked bits; unequal values may share a key, which costs comparisons only."""
    value = mix((fp.view(np.uint64) & np.uint64(mask)) ^ mix(np.array([mask], np.uint64)))
    return (value if base is None else mix(value + base.view(np.uint64))).view(np.int64)


def _entries(key: list, fp: list, used: list, slack: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, fp, used, slack)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:3]), pa.array(columns[3].astype(np.int32))], ["key", "fp", "used", "slack"])


def _indexed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array(batch.column(0))
            one = np.ones(len(fp), np.int64)
            yield _entries([_key(fp, m) for m in plan.masks], [fp] * len(plan.masks), [one * _signed(m) for m in plan.masks], [one * DISTANCE] * len(plan.masks))

    return run


def _probing(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array(batch.column(0))
            limits = plan.thresholds(fp)
            for i, (part, mask) in enumerate(zip(plan.parts, plan.masks, strict=True)):
                for d in range(DISTANCE + 1):
                    own = fp[limits[:, i] >= d]
                    if not len(own):
                        continue
                    flips = [np.int64(_signed(_mask(f))) for f in combinations(part, d)]
                    for a in range(0, len(flips), 64):
                        some = flips[a : a + 64]
                        yield _entries([_key(own ^ f, mask) for f in some], [own] * len(some), [np.full(len(own), _signed(mask))] * len(some), [np.full(len(own), DISTANCE - d)] * len(some))

    return run


def _finer(order: list[int], probing: bool):
    """Each entry once more for each third of its unused bits; a probe with ``slack`` bits left to differ needs slack + 1 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, used, slack = (np.array(batch.column(c)) for c in ("key", "fp", "used", "slack"))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for mask in np.unique(used).tolist():
                at = np.flatnonzero(used == mask)
                free = [b for b in order if not mask >> b & 1]
                for j in range(DISTANCE + 1):
                    part = _mask(free[j * len(free) // 3 : (j + 1) * len(free) // 3])
                    own = at[slack[at] >= j] if probing else at
                    for column, x in zip(out, (_key(fp[own], part, key[own]), fp[own], np.full(len(own), _signed((mask | part) & (1 << 64) - 1)), slack[own]), strict=True):
                        column.append(x)
            yield _entries(*out)

    return run


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Rows (a, b), a > b: the pairs of ``fps``'s distinct fingerprints (a column fp) at most DISTANCE bits apart; a pair may come more than once."""
    total = fps.count()
    # parts wide enough that unrelated fingerprints seldom share one
    m = min(4, max(2, BITS // max(1, total.bit_length())))
    parts = correlated_parts(fps, m)
    plan = Plan(parts, histograms(fps, parts), total)
    order = [b for p in parts for b in p]
    index = materialize(fps.select("fp").mapInArrow(_indexed(plan), ENTRY), "index")
    probes = materialize(fps.select("fp").mapInArrow(_probing(plan), ENTRY), "probes")
    links = []
    while True:
        free = BITS - F.min(F.bit_count("used"))
        large = index.groupBy("key").agg(F.count("*").alias("size"), free.alias("free")).where((F.col("size") > GROUP) & (F.col("free") > 9)).select("key")
        large = materialize(large, "large")
        none = large.isEmpty()
        few = index if none else index.join(large, "key", "left_anti")
        met = probes.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")).hint("merge"), "key")
        near = met.where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
        links.append(materialize(near.select("a", "b").distinct(), "links"))
        if none:
            break
        old = index, probes
        index, probes = (materialize(x.join(large, "key", "left_semi").select("key", "fp", "used", "slack").mapInArrow(_finer(order, p), ENTRY), n) for x, p, n in ((index, False, "index"), (probes, True, "probes")))
        for x in old:
            discard(x)
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, fingerprint (16 hexadecimal digits), component_id (the least id that links reach).

    Shingles: three words in a row after lower-casing A-Z, joined by a space,
    repeats included; with fewer words the whole sequence.  A bit is set if it
    is in over half the shingles' XXH64 (seed 42).  Fingerprints link at two
    or fewer differing bits.  Null, empty and blank texts have fingerprint
    zero and link like any other.  A null id is never the least unless its
    whole component has none.  Rows given twice are equal, hence linked; an
    empty table gives no rows; other columns are ignored.
    """
    held = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    # copies become one fingerprint before anything is compared
    fps = materialize(held.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    ends = components(near_fingerprints(fps), "a", "b").withColumnRenamed("node", "fp")
    rooted = materialize(fps.join(ends.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_hot(rooted.select("fp", "root"), first, "root").select("fp", "component_id")
    out = join_hot(held, named, "fp")
    return out.select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
