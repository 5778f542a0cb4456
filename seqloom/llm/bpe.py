"""Byte-level BPE by overlapping chunks.

A text of more than ``CHUNK`` code points becomes rows of chunks that overlap,
so the chunks of one text are pre-tokenised and encoded in different tasks.
The pattern looks back at nothing, so where two chunks have a pre-token
boundary at the same place inside their overlap, all later pre-tokens of both
agree: the text is stitched there.  A chunk's last pre-tokens may depend on
what follows, so boundaries near its end are not used.  Where two chunks have
no common boundary (one long run), the text is encoded in one go.  Each piece
is encoded by its ranks; decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot
from ..plans.scratch import materialize

CHUNK, OVERLAP = 32_768, 512
CACHE = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """(number, where it begins, characters) of the chunks of a text: each begins ``overlap`` before its place and reaches 2 * ``overlap`` into the next."""
    for number, at in enumerate(range(0, max(1, len(text)), chunk)):
        begin = max(0, at - overlap)
        yield number, begin, text[begin : at + chunk + 2 * overlap]


def tokens(text: str, number: int, begin: int, last: bool, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], int]:
    """A chunk's pre-tokens (begin, end in the whole text) up to the place where the next chunk takes over, and that place (-1: no common boundary)."""
    own = [(begin + m.start(), begin + m.end()) for m in pattern.finditer(text)]
    if last:
        return own, begin + len(text)
    # the next chunk begins at ``low``; a pre-token that is not the last one here was matched with all that it depends on
    low = (number + 1) * chunk - overlap
    far = [begin + m.start() for m in pattern.finditer(text, low - begin)]
    known = set(far[:-1])
    met = next((i for i, (a, _) in enumerate(own[:-1]) if a in known), None)
    return (own[:met], own[met][0]) if met is not None else (own, -1)


def pieces(text: str, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str] | None:
    """All pre-tokens of a text from those of its chunks, or None where two chunks have no common boundary."""
    every = list(chunks(text, chunk, overlap))
    out, start = [], 0
    for number, begin, part in every:
        own, after = tokens(part, number, begin, number == len(every) - 1, pattern, chunk, overlap)
        if after < 0:
            return None
        out += [text[a:b] for a, b in own if a >= start]
        start = after
    return out


class Encoder:
    """Pieces to ids, with a cache of pieces that is emptied when full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {b: a for a, b in ranks.items()}
        self.cache: dict[str, tuple[str, list[int], bytes]] = {}

    def piece(self, text: str) -> tuple[str, list[int], bytes]:
        """The ids of a pre-token, as decimals joined by spaces and as numbers, and the bytes that they decode to."""
        found = self.cache.get(text)
        if found is None:
            ids = self.core.encode_single_piece(text) if hasattr(self.core, "encode_single_piece") else self.core._encode_single_piece(text)
            found = " ".join(map(str, ids)), ids, self.decode(ids)
            if len(text) > 64:
                return found
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[text] = found
        return found

    def encode(self, text: str, keep: bool) -> tuple[int, str, str, list[int] | None]:
        """Number of ids, digests of the ids and of what they decode to, and the ids if they are kept."""
        every = [self.piece(x) for x in self.pattern.findall(text)]
        line, raw = " ".join([x[0] for x in every]), b"".join([x[2] for x in every])
        ids = [i for x in every for i in x[1]] if keep else None
        return sum([len(x[1]) for x in every]), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each document: id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` ids.

    Null texts are encoded as empty ones.  Rows given twice give two rows; a
    text of several chunks is encoded once, however often it is given.  The
    parts of one text meet only as ids, in the task that digests them in
    order.  ``ranks_path`` is read by the driver and sent to the workers: a
    vocabulary's size is fixed by its tokenizer.  Other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            found = [encoder.encode(x.as_py(), keep_ids) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(found)], ["id", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                every = list(chunks(text.as_py(), chunk, overlap))
                for at in range(0, len(every), 64):
                    part = every[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[0] == len(every) - 1 for x in part]), pa.array([x[2] for x in part], pa.string())], ["key", "number", "begin", "last", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's ids from each pre-token on that the chunk before may end at (``starts``, ``places``), and where it ends itself."""
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            for key, number, begin, last, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own, after = tokens(text, number, begin, last, encoder.pattern, chunk, overlap)
                ids = [encoder.piece(text[a - begin : b - begin])[1] for a, b in own]
                place = np.cumsum([0, *map(len, ids)])
                head = [i for i, (a, _) in enumerate(own) if a <= number * chunk + 2 * overlap]
                flat = np.array([i for x in ids for i in x], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([number], pa.int32()), pa.array([after], pa.int64()), pa.array([[own[i][0] for i in head]], pa.list_(pa.int64())), pa.array([place[head]], pa.list_(pa.int64())), pa.array([flat], pa.list_(pa.int32()))], ["key", "number", "after", "starts", "places", "ids"])

    token: dict[int, bytes] = {}  # filled once in each task

    def stitch(table: pa.Table) -> pa.Table:
        if not token:
            token.update({b: a for a, b in ranks.value.items()})
        line, decoded, kept, n, start = hashlib.sha256(), hashlib.sha256(), [], 0, 0
        order = np.argsort(np.array(table.column("number")))
        for row in order.tolist():
            after = table.column("after")[row].as_py()
            if after < 0:
                return _unstitched(table)
            starts = table.column("starts")[row].as_py()
            at = starts.index(start) if start in starts else len(starts)
            places = table.column("places")[row].as_py()
            ids = table.column("ids")[row].as_py()
            ids = ids[places[at] :] if at < len(places) else []
            if ids:
                line.update(b" " * (n > 0) + " ".join(map(str, ids)).encode())
                decoded.update(b"".join([token[i] for i in ids]))
            n += len(ids)
            if keep_ids:
                kept += ids
            start = after
        return pa.Table.from_arrays([table.column("key").slice(0, 1).combine_chunks(), *_columns([(n, line.hexdigest(), decoded.hexdigest(), kept if keep_ids else None)])], ["key", *names])

    long = rows.where(F.length("text") > chunk).withColumn("key", F.md5("text"))
    parts = long.groupBy("key").agg(F.first("text").alias("text")).select("key", "text").mapInArrow(cut, "key string, number int, begin long, last boolean, text string")
    parts = parts.repartition("key", "number").mapInArrow(encode, "key string, number int, after long, starts array<long>, places array<long>, ids array<int>")
    stitched = materialize(parts.groupBy("key").applyInArrow(stitch, "key string, " + RESULT), "stitched")
    # texts with a run that no chunk ends in are encoded in one go
    rest = long.select("id", "text", "key").join(stitched.where("n_tokens is null").select("key"), "key", "left_semi").select("id", "text")
    short = rows.where(F.length("text") <= chunk).unionByName(rest).mapInArrow(whole, f"id {id_type}, " + RESULT)
    out = short.unionByName(join_hot(long.select("id", "key"), stitched.where("n_tokens is not null"), "key").select("id", *names))
    return out.withColumnRenamed("id", id_col).select(id_col, *(names if keep_ids else names[:3]))


def _unstitched(table: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([table.column("key").slice(0, 1).combine_chunks(), *_columns([(None, None, None, None)])], ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
