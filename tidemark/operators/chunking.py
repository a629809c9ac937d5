"""Content-defined chunking of binary or text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ids

# Default chunk sizes and the limits a configuration must keep.
DEFAULT_SIZES = (64 * 1024, 256 * 1024, 1024 * 1024)
MINIMUM_RANGE = (64, 1024 * 1024)
AVERAGE_RANGE = (256, 4 * 1024 * 1024)
MAXIMUM_RANGE = (1024, 16 * 1024 * 1024)

WINDOW = 64
BLOCK = 1 << 20


def size_error(minimum: int, average: int, maximum: int) -> str | None:
    """First broken rule of a chunk-size configuration."""
    for name, value, (low, high) in (
        ("MINIMUM", minimum, MINIMUM_RANGE),
        ("AVERAGE", average, AVERAGE_RANGE),
        ("MAXIMUM", maximum, MAXIMUM_RANGE),
    ):
        if not low <= value <= high:
            return f"{name}_SIZE_OUT_OF_RANGE"
    if not minimum <= average <= maximum:
        return "INVALID_SIZE_ORDER"
    if average & (average - 1):
        return "AVERAGE_SIZE_NOT_POWER_OF_TWO"
    return None


def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20200814)).integers(
        0, 2**64, size=256, dtype=np.uint64
    )


GEAR = _gear()


def _masks(average: int) -> tuple[np.uint64, np.uint64]:
    """Strict mask below the average size, loose mask above it (top bits of the hash)."""
    bits = average.bit_length() - 1

    def top(n: int) -> np.uint64:
        return np.uint64(((1 << n) - 1) << (64 - n))

    return top(bits + 1), top(max(bits - 1, 1))


def candidates(data: np.ndarray, average: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a cut may fall, for the strict and the loose mask.

    The gear hash at a byte depends on the 64 bytes that end there. It is built for a whole
    block at once: windows of 1, 2, 4 ... 64 bytes, each from two of the previous length.
    """
    strict, loose = _masks(average)
    hits_strict, hits_loose = [], []
    for start in range(0, len(data), BLOCK):
        begin = max(start - (WINDOW - 1), 0)
        h = GEAR[data[begin : start + BLOCK]]
        width = 1
        while width < WINDOW:
            shifted = h[:-width] << np.uint64(width)
            h[width:] += shifted
            width *= 2
        h = h[start - begin :]
        loose_at = np.flatnonzero((h & loose) == 0)
        strict_at = loose_at[(h[loose_at] & strict) == 0]
        hits_loose.append(loose_at + (start + 1))
        hits_strict.append(strict_at + (start + 1))
    if not hits_loose:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hits_strict), np.concatenate(hits_loose)


def cut_points(offsets: np.ndarray, data: np.ndarray, sizes: tuple[int, int, int]) -> list[list[int]]:
    """End positions of the chunks of each value in a buffer of back-to-back values.

    No cut is nearer than 64 bytes to the start of its chunk, so a hash window never reaches
    into the value before it and the cuts do not depend on how rows were batched.
    """
    minimum, average, maximum = sizes
    strict, loose = candidates(data, average)
    strict_list, loose_list = strict.tolist(), loose.tolist()
    n_strict, n_loose = len(strict_list), len(loose_list)
    out = []
    si = li = 0
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts = []
        while start < end:
            if end - start <= minimum:
                cut = end
            else:
                near = min(start + average, end)
                far = min(start + maximum, end)
                cut = far
                while si < n_strict and strict_list[si] < start + minimum:
                    si += 1
                if si < n_strict and strict_list[si] < near:
                    cut = strict_list[si]
                else:
                    while li < n_loose and loose_list[li] < near:
                        li += 1
                    if li < n_loose and loose_list[li] < far:
                        cut = loose_list[li]
            cuts.append(cut)
            start = cut
        out.append(cuts)
    return out


def _chunk_batch(batch: pa.RecordBatch, sizes: tuple[int, int, int]) -> pa.RecordBatch:
    """One output row per chunk; payloads are slices of the input buffer, not copies."""
    content = batch.column("content").cast(pa.large_binary())
    content = content.fill_null(b"") if content.null_count else content
    first = content.offset
    raw_offsets, raw_data = content.buffers()[1], content.buffers()[2]
    offsets = np.frombuffer(raw_offsets, np.int64)[first : first + len(content) + 1]
    base = int(offsets[0])
    length = int(offsets[-1]) - base
    data = (
        np.frombuffer(raw_data, np.uint8)[base : base + length]
        if raw_data is not None and length
        else np.empty(0, np.uint8)
    )
    starts = offsets - base
    per_value = cut_points(starts, data, sizes)
    counts = np.fromiter((len(c) for c in per_value), np.int64, len(per_value))
    ends = np.array([c for cuts in per_value for c in cuts], np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    rows = np.repeat(np.arange(len(per_value)), counts)
    index = np.arange(len(ends)) - np.repeat(np.cumsum(counts) - counts, counts)
    payload = pa.Array.from_buffers(
        pa.large_binary(),
        len(ends),
        [None, pa.py_buffer(np.append(begins[:1], ends).astype(np.int64)), pa.py_buffer(data)],
    ) if len(ends) else pa.array([], pa.large_binary())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("id").take(pa.array(rows)),
            pa.array(index, pa.int64()),
            pa.array(begins - starts[rows], pa.int64()),
            pa.array(ends - begins, pa.int64()),
            payload.cast(pa.binary()),
        ],
        names=["id", "chunk_index", "offset", "size", "payload"],
    )


def cdc_chunk(
    df: DataFrame,
    id_column: str,
    content: str,
    minimum: int = DEFAULT_SIZES[0],
    average: int = DEFAULT_SIZES[1],
    maximum: int = DEFAULT_SIZES[2],
    key: str = "",
    payload: bool = True,
) -> DataFrame:
    """Chunk rows ``(id, chunk_index, offset, size[, payload], content_id)`` of each value.

    The chunks of a value cover it without gap; all but the last are between ``minimum`` and
    ``maximum`` bytes. Equal values give equal chunks and a local edit moves few of them.
    An empty value has no chunk. No shuffle.
    """
    problem = size_error(minimum, average, maximum)
    if problem:
        raise ValueError(problem)
    sizes = (minimum, average, maximum)
    source = df.select(F.col(id_column).alias("id"), F.col(content).cast("binary").alias("content"))
    schema = T.StructType(
        [
            T.StructField("id", source.schema["id"].dataType),
            T.StructField("chunk_index", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _chunk_batch(batch, sizes)

    chunks = source.mapInArrow(run, schema).withColumn(
        "content_id", ids.content_id(F.col("payload"), ids.CHUNK, key)
    )
    return chunks if payload else chunks.drop("payload")
