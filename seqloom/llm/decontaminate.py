"""Benchmark passages in documents, found by q-gram counting and banded alignment.

A document holds an item if some window of ``WIDTH`` bytes of the item, at any
offset, occurs in it with at most ``EDITS`` edits (shorter items: the whole
item, with edits in proportion).  A window with e edits shares at least
width - Q + 1 - Q * e of its q-grams with the place where it occurs (q-gram
lemma), all on at most e + 1 neighbouring diagonals (document place minus item
place).  Hits are counted in overlapping bands of ``BAND`` diagonals, half of
them beginning in the middle of the others, so one band holds them all.
Windows that reach the bound in a band are verified by an alignment within the
band, all windows of a batch at once.  So no window within its budget is missed.

Items of fewer than ``LEAST`` bytes are searched exactly, as whole words.

Texts are compared in lower case with white space as single spaces.  A q-gram
of 8 bytes is one 64-bit number, so q-grams are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

Q, WIDTH, EDITS = 8, 48, 3
#: Items with fewer bytes are searched whole and without edits.
LEAST = 24
BAND = 2 * (EDITS + 1)
TABLE_BITS = 21
#: Bytes of benchmark text in one index; longer items are cut into pieces that share WIDTH - 1 bytes.
SLICE_BYTES, PIECE_BYTES = 2 << 20, 4096
#: How often an index may hold one q-gram: what one place of a document can expand to.
MOST = 8192
BATCH_BYTES = 256 << 10
#: Expanded q-gram hits, and windows to align, that are held at once.
ENTRIES, WINDOWS = 1 << 21, 1 << 17
#: A match and all its q-grams lie within so many bytes of a document.
REACH = WIDTH + EDITS + Q
#: Bits (as a power of two) of the table in which all q-grams of a benchmark of several slices are looked up first.
FILTER_BITS = 27


def normalise(text: str | bytes | None) -> bytes:
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return b" ".join((raw.lower() if raw.isascii() else raw.decode().lower().encode()).split())


def grams(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number: a view of the bytes, not a copy."""
    return np.ndarray((max(0, len(buf) - Q + 1),), "<u8", buffer=buf.data if len(buf) else b"", strides=(1,))


def slots(values: np.ndarray, bits: int) -> np.ndarray:
    out = values * np.uint64(0x9E3779B97F4A7C15)
    out >>= np.uint64(64 - bits)
    return out.view(np.int64)


def budget(width: int) -> tuple[int, int]:
    """The edits allowed in a window, and the q-grams then shared at least."""
    edits = EDITS * width // WIDTH
    while edits and width - Q + 1 - Q * edits < 4:
        edits -= 1
    return edits, width - Q + 1 - Q * edits


def split(text: bytes) -> Iterator[bytes]:
    """Pieces of an item that hold every window of it."""
    for at in range(0, max(1, len(text) - WIDTH + 1), PIECE_BYTES - WIDTH + 1):
        yield text[at : at + PIECE_BYTES]


class Index:
    """The q-grams of some pieces of items, with the item and the place of each."""

    def __init__(self, texts: list[bytes], items: list[int] | None = None) -> None:
        self.items = np.arange(len(texts)) if items is None else np.array(items)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        length = np.array([len(t) for t in texts], np.int64)
        self.offset = np.cumsum(length) - length
        every = [grams(np.frombuffer(t, np.uint8)) for t in texts]
        values = np.concatenate([np.zeros(0, np.uint64), *every])
        piece = np.repeat(np.arange(len(texts), dtype=np.int32), [len(g) for g in every])
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(g), dtype=np.int32) for g in every)])
        order = np.argsort(values, kind="stable")
        self.values, first, count = np.unique(values[order], return_index=True, return_counts=True)
        self.first, self.count, self.piece, self.place = first, count, piece[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slots(self.values, TABLE_BITS)] = True
        self.last = np.maximum(length - WIDTH, 0)
        self.width = np.minimum(length, WIDTH)
        self.edits, self.bound = (np.array(x, np.int64) for x in zip(*[budget(w) for w in self.width.tolist()], strict=True)) if texts else (length, length)
        self.least = int(self.bound.min(initial=WIDTH))


def indexes(texts: list[tuple[int, bytes]]) -> Iterator[Index]:
    """Indexes of all items (number, text) in which no q-gram occurs more than ``MOST`` times."""
    pieces = [(number, piece) for number, text in texts for piece in split(text)]
    every = [grams(np.frombuffer(piece, np.uint8)) for _, piece in pieces]
    at = 0
    while at < len(pieces):
        values = np.concatenate(every[at:])
        owner = np.repeat(np.arange(at, len(pieces)), [len(g) for g in every[at:]])
        order = np.argsort(values, kind="stable")
        start = np.flatnonzero(np.diff(values[order], prepend=~values[order[:1]]))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
        over = owner[order[rank >= MOST]]
        to = int(over.min()) if len(over) else len(pieces)  # a piece is shorter than MOST, so at least one fits
        yield Index([piece for _, piece in pieces[at:to]], [number for number, _ in pieces[at:to]])
        at = to


def dense(near: np.ndarray, least: int, span: int = WIDTH + EDITS - Q + 1) -> np.ndarray:
    """Which places lie in a span with ``least`` places that are ``near``."""
    span = min(span, len(near))
    total = np.zeros(len(near) + 1, np.int32)
    np.cumsum(near, out=total[1:])
    full = np.flatnonzero(total[span:] - total[:-span] >= least)
    edge = np.zeros(len(near) + 1, np.int32)
    np.add.at(edge, full, 1)
    np.add.at(edge, full + span, -1)
    return np.cumsum(edge)[:-1] > 0


def align(index: Index, piece: np.ndarray, start: np.ndarray, buf: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least edits of an alignment within its band (or more than allowed), and where in ``buf`` it ends.

    Window i begins at ``start[i]`` of its piece; its band begins where its
    first byte lies on ``low[i]`` of ``buf``.  Line feeds separate documents
    and match nothing.
    """
    over = np.int8(EDITS + 1)
    cost, end = np.full(len(piece), over, np.int64), np.zeros(len(piece), np.int64)
    step = np.arange(BAND)
    width = index.width[piece]
    for wide in np.unique(width).tolist():
        live = np.flatnonzero(width == wide)
        row = np.zeros((len(live), BAND), np.int8)
        pattern = (index.offset[piece] + start)[live]
        at = low[live][:, None] + step
        for r in range(wide):
            seen = buf[at + r]
            wall = (seen == 10) * over
            new = row + np.maximum(seen != index.bytes[pattern + r][:, None], wall)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            skip = np.maximum(wall, 1)
            for k in range(1, BAND):
                new[:, k] = np.minimum(new[:, k], new[:, k - 1] + skip[:, k])
            row = np.minimum(new, over)
            if r % 8 == 7:
                go = row.min(axis=1) < over
                if not go.all():
                    live, row, pattern, at = live[go], row[go], pattern[go], at[go]
        best = row.argmin(axis=1)
        cost[live], end[live] = row[np.arange(len(live)), best], low[live] + best + wide
    return cost, end


def _candidates(index: Index, doc: np.ndarray, piece: np.ndarray, place: np.ndarray, source: np.ndarray, half: int) -> tuple[np.ndarray, ...]:
    """(document, piece, window start, first diagonal of the band) of the windows that reach their bound in a band."""
    band = (source - place + half) // BAND
    order = np.lexsort((place, band, piece, doc))
    doc, piece, band, place = doc[order], piece[order], band[order], place[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]) & (band[1:] == band[:-1])
    # a q-gram of the item counts once, however often the document repeats it
    again = same.copy()
    again[1:] &= place[1:] == place[:-1]
    doc, piece, band, place, same = doc[~again], piece[~again], band[~again], place[~again], same[~again]
    group = np.cumsum(~same)
    # the i-th place and the (bound - 1)-th after it lie in the windows that begin from low to high
    i = np.arange(len(doc))
    then = i + index.bound[piece] - 1
    ok = then < len(doc)
    ok[ok] = group[then[ok]] == group[ok]
    i, then = i[ok], then[ok]
    low = np.maximum(place[then] - index.width[piece[i]] + Q, 0)
    high = np.minimum(place[i], index.last[piece[i]])
    before = np.full(len(i), -1)
    before[1:] = np.where(group[i[1:]] == group[i[:-1]], np.maximum.accumulate(high + group[i] * (1 << 32))[:-1] - group[i[1:]] * (1 << 32), -1)
    low = np.maximum(low, before + 1)
    many = np.maximum(high - low + 1, 0)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    i = np.repeat(i, many)
    return doc[i], piece[i], start, band[i] * BAND - half


def search(index: Index, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, first, end, edits): each item's matched region in each document."""
    pad = b"\n" * (2 * REACH)
    buf = np.frombuffer(pad + b"\n".join(docs) + pad, np.uint8)
    begin = len(pad) + np.cumsum([0, *(len(d) + 1 for d in docs)])
    gram = grams(buf)
    if not len(index.values):
        return
    near = index.table[slots(gram, TABLE_BITS)]
    at = np.flatnonzero(near & dense(near, index.least))
    slot = np.minimum(np.searchsorted(index.values, gram[at]), len(index.values) - 1)
    real = index.values[slot] == gram[at]
    at, slot = at[real], slot[real]
    count = index.count[slot]
    load = np.concatenate([[0], np.cumsum(count)])
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    a = 0
    while a < len(at):
        # as many places as expand to ENTRIES hits, but enough to hold a match; the next part begins before the end of this one
        b = max(int(np.searchsorted(load, load[a] + ENTRIES)), int(np.searchsorted(at, at[a] + 4 * REACH)))
        b = min(b, len(at))
        many = count[a:b]
        source = np.repeat(at[a:b], many)
        entry = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.first[slot[a:b]], many)
        doc = np.searchsorted(begin, source, side="right") - 1
        for half in (0, BAND // 2):
            own, piece, start, low = _candidates(index, doc, index.piece[entry], index.place[entry].astype(np.int64), source, half)
            for x in range(0, len(own), WINDOWS):
                part = slice(x, x + WINDOWS)
                edits, end = align(index, piece[part], start[part], buf, low[part] + start[part])
                hit = edits <= index.edits[piece[part]]
                width = index.width[piece[part]][hit]
                end = end[hit] - begin[own[part][hit]]
                for d, i, f, e, c in zip(own[part][hit].tolist(), index.items[piece[part][hit]].tolist(), np.maximum(end - width, 0).tolist(), end.tolist(), edits[hit].tolist(), strict=True):
                    old = found.get((d, i), (f, e, c))
                    found[d, i] = min(old[0], f), max(old[1], e), min(old[2], c)
        a = b if b == len(at) else max(a + 1, int(np.searchsorted(at, at[b - 1] - 2 * REACH)))
    for (d, i), region in found.items():
        yield d, i, *region


def _wordy(b: int) -> bool:
    return 48 <= b < 58 or 97 <= b < 123


class Short:
    """Items of fewer than ``LEAST`` bytes by their first 8 bytes, or all if they have fewer."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        by: dict[int, dict[int, list[int]]] = {}
        for i, t in enumerate(texts):
            by.setdefault(min(len(t), Q), {}).setdefault(int.from_bytes(t[:Q], "little"), []).append(i)
        self.heads = [(np.uint64((1 << 8 * n) - 1), np.array(sorted(heads), np.uint64), heads) for n, heads in sorted(by.items())]

    def search(self, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """As ``search``; no letter or digit (of ASCII) may go on beyond an end of the item that is one."""
        if not self.heads:
            return
        whole = b"\n".join([b"", *docs, b"\n" * Q])
        begin = 1 + np.cumsum([0, *(len(d) + 1 for d in docs)])
        gram = grams(np.frombuffer(whole, np.uint8))
        found: dict[tuple[int, int], list[int]] = {}
        for mask, values, heads in self.heads:
            masked = gram & mask
            table = np.zeros(1 << TABLE_BITS, bool)
            table[slots(values, TABLE_BITS)] = True
            at = np.flatnonzero(table[slots(masked, TABLE_BITS)])
            at = at[np.isin(masked[at], values)]
            for place, own in zip(at.tolist(), (np.searchsorted(begin, at, side="right") - 1).tolist(), strict=True):
                for item in heads[int(masked[place])]:
                    text = self.texts[item]
                    end = place + len(text)
                    if whole[place:end] == text and not (_wordy(text[0]) and _wordy(whole[place - 1])) and not (_wordy(text[-1]) and _wordy(whole[end])):
                        first = place - int(begin[own])
                        found.setdefault((own, item), [first, 0])[1] = first + len(text)
        for (own, item), (first, end) in found.items():
            yield own, item, first, end, 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each document and benchmark item found in it: id, item, first, end, edits.

    ``first`` and ``end`` are bytes of the document's normalised text.  Null
    and empty texts on either side match nothing.  Items of fewer than
    ``LEAST`` bytes are found whole only, without edits.  A row given twice is
    reported twice; items with equal texts are each reported.  Other columns
    are ignored.  The benchmark is read in slices of ``slice_bytes`` on
    average.  If there are several, one pass over the documents writes those
    that can match by a table of all q-grams (of a fixed size), and only these
    are read again for each slice, whose hits are written before the next slice
    is read: the driver holds one slice, however large the benchmark.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    slices = max(1, -(-(items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // slice_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = rows.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    arrow_item = items.select("item").limit(0).toArrow().schema.field(0).type

    def part(number: int) -> list[tuple]:
        found = [(r.item, normalise(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == number).collect()]
        return [x for x in found if x[1]]

    if slices > 1:
        rows = materialize(_able(rows, (x[1] for number in range(slices) for x in part(number)), f"id {id_type}, text string"), "able")
    out = None
    for number in range(slices):
        sent = spark.sparkContext.broadcast(part(number))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            usual, brief = ([x for x in sent.value if (len(x[1]) < LEAST) == low] for low in (False, True))
            usual_indexes, short = list(indexes([(i, x[1]) for i, x in enumerate(usual)])), Short([x[1] for x in brief])
            ids = [x[0] for x in usual + brief]
            for batch in batches:
                held, size, start = [], 0, 0
                texts = batch.column(1).cast(pa.binary())
                for i in range(batch.num_rows + 1):
                    if i == batch.num_rows or size >= BATCH_BYTES:
                        hits = [h for index in usual_indexes for h in search(index, held)]
                        if len(usual_indexes) > 1:  # an item cut into pieces may be in several indexes
                            hits = _merged(hits)
                        hits += [(h[0], len(usual) + h[1], *h[2:]) for h in short.search(held)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([start + h[0] for h in hits], pa.int64())), pa.array([ids[h[1]] for h in hits], arrow_item), *(pa.array([h[j] for h in hits], pa.int64()) for j in (2, 3, 4))], ["id", "item", "first", "end", "edits"])
                        held, size, start = [], 0, i
                    if i < batch.num_rows:
                        held.append(normalise(texts[i].as_py()))
                        size += len(held[-1])

        hits = rows.mapInArrow(run, f"id {id_type}, item {item_type}, first long, end long, edits long")
        if slices > 1:  # one slice at a time in the memory of the driver and the executors
            hits = materialize(hits, "hits")
            sent.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _merged(hits: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, f, e, c in hits:
        old = found.get((d, i), (f, e, c))
        found[d, i] = min(old[0], f), max(old[1], e), min(old[2], c)
    return [(d, i, *region) for (d, i), region in found.items()]


def _able(rows: DataFrame, texts: Iterator[bytes], schema: str) -> DataFrame:
    """The rows that may hold one of the texts, by a table of their q-grams; all rows if a text is too short for one."""
    table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    least, every = WIDTH, False
    for text in texts:
        every = every or len(text) < Q
        at = slots(grams(np.frombuffer(text, np.uint8)).copy(), FILTER_BITS)
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        least = min(least, budget(min(len(text), WIDTH))[1] if len(text) >= LEAST else max(1, len(text) - Q + 1))
    if every:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast((table, least))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, least = sent.value
        for batch in batches:
            able = []
            for text in batch.column(1).cast(pa.binary()):
                at = slots(grams(np.frombuffer(normalise(text.as_py()), np.uint8)).copy(), FILTER_BITS)
                able.append(bool(len(at)) and bool(dense((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool), least).any()))
            yield batch.filter(pa.array(able, pa.bool_()))

    return rows.mapInArrow(keep, schema)
