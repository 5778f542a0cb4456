"""Counting keys over all documents, without shuffling a row for each key.

Documents are packed into blocks of a few megabytes and written once, so a
block keeps its number and its contents whatever is lost or run again.  Each
block sends the sorted distinct 64-bit keys of its documents to buckets (key
ranges) as delta-coded byte planes, with the number of times that it holds
each.  A bucket answers each block with one bit for each key (does it occur
more than once?) and the sums for those that do.  A key that a third of all
documents hold thus costs one entry for each block, never one for each document.

The work for a block grows with its keys, not with the number of buckets: a
block sends at least ``ROW_KEYS`` keys to each on average.  So the larger the
corpus, the larger are its blocks (``block_size``), up to ``LARGEST_BLOCK``,
and with them the number of buckets; a bucket has about ``BUCKET_KEYS`` keys
for some ten gigabytes of text, ten million at a terabyte and a hundred
million (a gigabyte and a half in its task) at a hundred terabytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize, shuffle_partitions

BLOCK_BYTES, LARGEST_BLOCK = 3 << 20, 64 << 20
#: Bytes of input for each byte of a block, where that lies between the two.
INPUT_PER_BLOCK_BYTE = 150_000
BUCKET_KEYS = 1_000_000
#: A block sends at least so many keys to a bucket on average, however large the corpus is.
ROW_KEYS = 64
KEYS = "bucket int, block long, n int, keys binary, times binary"

KeysOf = Callable[..., tuple[np.ndarray, np.ndarray]]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in a text column each, or one row if that is longer."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def block_size(input_bytes: int) -> int:
    """Bytes of a block for an input of so many bytes."""
    return min(LARGEST_BLOCK, max(BLOCK_BYTES, input_bytes // INPUT_PER_BLOCK_BYTE))


def planned_bytes(df: DataFrame) -> int:
    """The size of ``df`` as its plan estimates it from the files' sizes; 0 if it cannot tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def pack(df: DataFrame, text: str, block_bytes: int | None = None) -> DataFrame:
    """Blocks of ``df``'s rows, written to the shared folder: block, n_docs, n_bytes, payload."""
    block_bytes = block_bytes or block_size(planned_bytes(df))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            row = pa.RecordBatch.from_arrays(
                [pa.array([(part << 22) + number], pa.int64()), pa.array([whole.num_rows], pa.int32()), pa.array([size], pa.int64()), pa.array([_ipc(whole)], pa.binary())],
                ["block", "n_docs", "n_bytes", "payload"],
            )
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + block_bytes - size, side="right")) - 1
                to = min(batch.num_rows, max(to, at if held else at + 1))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(offsets[to] - offsets[at])
                at = to
                if at < batch.num_rows or size >= block_bytes or sum(x.num_rows for x in held) >= 50_000:
                    yield out()
        if held:
            yield out()

    return materialize(df.mapInArrow(fold, "block long, n_docs int, n_bytes long, payload binary"), "blocks")


def encode(keys: np.ndarray) -> bytes:
    """Sorted keys as the byte planes of their differences; the shuffle's compression drops the planes of zeros."""
    deltas = np.diff(keys, prepend=np.uint64(0))
    return deltas.view(np.uint8).reshape(-1, 8).T.tobytes()


def decode(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as byte planes, those of zeros left out."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([width]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def numbers(data) -> np.ndarray:
    plane = np.frombuffer(data, np.uint8)[1:].reshape(data[0], -1)
    return sum(x.astype(np.uint32) << np.uint32(8 * i) for i, x in enumerate(plane))


def cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets that sorted keys fall into."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=False))


def bucket_count(total_keys: float, blocks: int, partitions: int) -> int:
    """A power of two: about ``BUCKET_KEYS`` keys in each bucket, but not so many buckets that a block sends fewer than ``ROW_KEYS`` keys to each."""
    wanted = max(2 * partitions, total_keys / BUCKET_KEYS)
    if total_keys > BUCKET_KEYS:
        wanted = min(wanted, max(total_keys / max(1, blocks) / ROW_KEYS, 2 * partitions))
    return 1 << max(int(wanted - 1).bit_length(), 1)


def bucket_bits(blocks: DataFrame, keys_per_byte: float) -> int:
    """Bits that choose a bucket."""
    size = blocks.agg(F.sum("n_bytes").alias("n"), F.count("*").alias("blocks")).first()
    return bucket_count((size.n or 0) * keys_per_byte, size.blocks, shuffle_partitions(blocks.sparkSession)).bit_length() - 1


def _answer(table: pa.Table) -> pa.Table:
    """How often the keys of one bucket occur, for each block that holds a repeated one."""
    blocks = table.column("block").to_pylist()
    sizes = np.array(table.column("n").to_pylist(), np.int64)
    keys = np.concatenate([decode(x.as_buffer()) for x in table.column("keys")])
    times = np.concatenate([numbers(x.as_buffer()) for x in table.column("times")]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.minimum(np.add.reduceat(times[order], first), (1 << 32) - 1)
    times[order] = np.repeat(sums, np.diff(first, append=len(keys)))
    out = [(block, part > 1, part) for block, part in zip(blocks, np.split(times, np.cumsum(sizes)[:-1]), strict=True) if part.max() > 1]
    return pa.table(
        {
            "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int32()),
            "block": pa.array([x[0] for x in out], pa.int64()),
            "mask": pa.array([np.packbits(x[1]).tobytes() for x in out], pa.binary()),
            "times": pa.array([planes(x[2][x[1]]) for x in out], pa.binary()),
        }
    )


def counted(blocks: DataFrame, keys_of: KeysOf, keys_per_byte: float, name: str = "answers", needs: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``blocks`` with a column ``name`` of answers, and the number of bits that choose a bucket.

    ``keys_of`` gives the sorted distinct keys of a block and how often the
    block holds each, from its payload and the columns ``needs``.  The answers
    tell how often the keys occur in all blocks (see ``totals``).
    """
    bits = bucket_bits(blocks, keys_per_byte)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, *more in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                keys, times = keys_of(unpacked(payload.as_buffer()), *more)
                rows = cut(keys, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in rows], pa.int32()),
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array([b - a for _, a, b in rows], pa.int32()),
                        pa.array([encode(keys[a:b]) for _, a, b in rows], pa.binary()),
                        pa.array([planes(times[a:b]) for _, a, b in rows], pa.binary()),
                    ],
                    ["bucket", "block", "n", "keys", "times"],
                )

    answers = blocks.select("block", "payload", *needs).mapInArrow(send, KEYS).groupBy("bucket").applyInArrow(_answer, "bucket int, block long, mask binary, times binary")
    # written: the keys' shuffle files can go, and nothing is sent twice
    answers = materialize(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask", "times")).alias(name)), name)
    return blocks.join(answers.hint("merge"), "block", "left"), bits


def totals(keys: np.ndarray, answers, bits: int) -> np.ndarray:
    """For each of a block's sorted distinct keys, how often it occurs in all blocks."""
    out = np.ones(len(keys), np.int64)
    place = {i: (a, b) for i, a, b in cut(keys, bits)}
    for answer in answers.as_py() or []:
        a, b = place[answer["bucket"]]
        again = np.flatnonzero(np.unpackbits(np.frombuffer(answer["mask"], np.uint8), count=b - a))
        out[a + again] = numbers(answer["times"])
    return out
