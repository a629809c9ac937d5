"""Token ids in files of bit- or byte-planes.

Documents are written in ascending id order. Each range of ids is one shard, a stream of ids cut
into blocks of a fixed size. A block's ids are transposed: plane k holds bit or byte k of every id,
so the planes of high bits are nearly constant, and each plane is a zstandard frame of its own.
A file is a Parquet table with one row per block, so Spark's own writer commits it and any
store it reads will do. The chunk index has the place and the plane ends of every block without
the data.

Defined cases: a NULL or empty text is the end id alone; NULL ids come first; rows with equal
ids keep the order of their texts, and each is a document of its own; an empty table gives empty
files; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import new_path, small_batches
from tidemark.llm.tokens import encoder

BLOCK_IDS = 1 << 16
END_ID = 2
LEVEL = 3
#: Bits of an id that form one plane.
BIT, BYTE = 1, 8

_BLOCK_FIELDS = (
    "shard int, block bigint, first bigint, n_ids int, plane_bits int, plane_ends array<int>, data binary, "
    "doc_ids array<{kind}>, doc_starts array<bigint>, doc_lengths array<bigint>"
)


def to_planes(ids: np.ndarray, plane_bits: int = BYTE, level: int = LEVEL) -> tuple[list[int], bytes]:
    """Ends of the compressed planes, and the planes one after the other."""
    import zstandard

    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == BIT:
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    compress = zstandard.ZstdCompressor(level=level).compress
    frames = [compress(p.tobytes()) for p in planes]
    return np.cumsum([len(f) for f in frames]).tolist(), b"".join(frames)


def from_planes(data: bytes, ends: list[int], n_ids: int, plane_bits: int) -> np.ndarray:
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    frames = [data[a:b] for a, b in zip([0, *ends], ends)]
    planes = [np.frombuffer(decompress(f), np.uint8) for f in frames]
    if plane_bits == BIT:
        bits = np.stack([np.unpackbits(p, count=n_ids, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.stack(planes, axis=1)
    return np.ascontiguousarray(rows).view("<u4").ravel()


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    plane_bits: int = BYTE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Write ``path``/blocks and ``path``/index."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else None

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        shard, block, first, held = TaskContext.get().partitionId(), 0, 0, 0
        end = np.array([end_id], "<u4")
        waiting: list[np.ndarray] = []
        known: list[tuple] = []  # documents with ids in what is waiting
        at = 0

        def row(ids: np.ndarray) -> pa.RecordBatch:
            ends, data = to_planes(ids, plane_bits)
            inside = [d for d in known if d[1] < first + len(ids)]
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int64()),
                pa.array([first], pa.int64()),
                pa.array([len(ids)], pa.int32()),
                pa.array([plane_bits], pa.int32()),
                pa.array([ends], pa.list_(pa.int32())),
                pa.array([data], pa.binary()),
                pa.array([[d[0] for d in inside]], pa.list_(id_type) if id_type else None),
                pa.array([[d[1] for d in inside]], pa.list_(pa.int64())),
                pa.array([[d[2] for d in inside]], pa.list_(pa.int64())),
            ]
            names = "shard block first n_ids plane_bits plane_ends data doc_ids doc_starts doc_lengths".split()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, found in zip(keys, encode([t or "" for t in batch.column(1).to_pylist()])):
                known.append((key, at, len(found) + 1))
                at += len(found) + 1
                held += len(found) + 1
                waiting += [found, end]
                if held < block_ids:
                    continue
                ids = np.concatenate(waiting)
                while len(ids) >= block_ids:
                    yield row(ids[:block_ids])
                    ids, block, first = ids[block_ids:], block + 1, first + block_ids
                    known = [d for d in known if d[1] + d[2] > first]
                waiting, held = [ids], len(ids)
        if held:
            yield row(np.concatenate(waiting))

    ordered = (
        docs.select(F.col(doc_id), F.col(text))
        .repartitionByRange(F.col(doc_id))
        .sortWithinPartitions(doc_id, text)
    )
    written = ordered.mapInArrow(blocks, _BLOCK_FIELDS.format(kind=kind))
    written.write.option("compression", "none").parquet(f"{path}/blocks")
    index = spark.read.parquet(f"{path}/blocks").select(
        "shard", "block", "first", "n_ids", "plane_bits", "plane_ends"
    )
    index.write.parquet(f"{path}/index")


def _shift(crc: int, n_bytes: int) -> int:
    """crc32 of a message with ``n_bytes`` zero bytes put behind it, without its final masks.

    Appending a byte multiplies by x**8 modulo the polynomial; bit 31 is the coefficient of 1.
    """

    def times(a: int, b: int) -> int:
        product = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                product ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return product

    factor, power = 1 << 31, 1 << 23
    while n_bytes:
        if n_bytes & 1:
            factor = times(factor, power)
        power = times(power, power)
        n_bytes >>= 1
    return times(factor, crc)


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """crc32 of a message from (length in bytes, crc32) of its parts in order."""
    total = 0
    for length, crc in parts:
        total = _shift(total, length) ^ crc
    return total


def read_parts(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """What each block holds of each document: (shard, doc_id, start, n_tokens, part_start,
    part_length, crc[, ids]); ``start`` counts from the start of the shard."""
    blocks = spark.read.parquet(f"{path}/blocks")
    small_batches(spark, 8)
    kind = blocks.schema["doc_ids"].dataType.elementType

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = from_planes(b["data"], b["plane_ends"], b["n_ids"], b["plane_bits"])
                rows = []
                for key, start, length in zip(b["doc_ids"], b["doc_starts"], b["doc_lengths"]):
                    low = max(start, b["first"])
                    high = min(start + length, b["first"] + b["n_ids"])
                    piece = ids[low - b["first"] : high - b["first"]]
                    rows.append((b["shard"], key, start, length, low, high - low, zlib.crc32(piece.tobytes()), piece))
                names = ["shard", "doc_id", "start", "n_tokens", "part_start", "part_length", "crc", "ids"]
                kinds = [pa.int32(), batch.schema.field("doc_ids").type.value_type, *[pa.int64()] * 5]
                kinds.append(pa.list_(pa.int32()))
                columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(7 + with_ids)]
                yield pa.RecordBatch.from_arrays(columns, names=names[: 7 + with_ids])

    fields = f"shard int, doc_id {kind.simpleString()}, start bigint, n_tokens bigint, part_start bigint, part_length bigint, crc bigint"
    return blocks.mapInArrow(parts, fields + (", ids array<int>" if with_ids else ""))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, ``start`` over all shards."""
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        spark.read.parquet(f"{path}/index")
        .groupBy("shard")
        .agg(F.sum("n_ids").alias("_n"))
        .select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    parts = read_parts(spark, path)

    def join_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [
                joined_crc32([(4 * p["part_length"], p["crc"]) for p in row])
                for row in batch.column("parts").to_pylist()
            ]
            kept = [batch.column(c) for c in ("shard", "doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sums, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
            )

    whole = parts.where(F.col("part_length") == F.col("n_tokens")).select(
        "shard", "doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32")
    )
    # One part per block of a document that crosses blocks.
    split = (
        parts.where(F.col("part_length") < F.col("n_tokens"))
        .groupBy("shard", "doc_id", "start", "n_tokens")
        .agg(F.array_sort(F.collect_list(F.struct("part_start", "part_length", "crc"))).alias("parts"))
    )
    split = split.mapInArrow(join_crc, whole.schema)
    return (
        whole.unionByName(split)
        .join(bases, "shard")
        .select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")
    )


def encode_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of ``docs`` to a new folder and read the digests back from the files."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(docs, tokenizer, path, **options)
    return read_digests(spark, path)
