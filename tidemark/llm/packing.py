"""Packing token pieces into sequences: best fit, then swap-based local search.

Pieces are dealt at random into groups of some 20,000, each packed by one task. Best fit puts
the longest pieces first into the fullest sequence that takes them. The search then takes the
underfull sequences from the fullest down and moves one piece in, exchanges one for one, two
for one or one for two with emptier sequences, whichever leaves the least room, so the sum of
squared fills grows until sequences empty. What stays underfull is dealt anew and packed again.

Defined cases: a NULL or empty text is the end id alone; only texts longer than a sequence are
cut, and the last piece may be short; repeated rows are packed one by one; ids may be NULL; an
empty table gives an empty result; extra columns are ignored by ``token_pieces`` and carried by
``pack``, which replaces columns named sequence_id and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches, stored
from tidemark.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 20_000
ROUNDS = 2
PASSES = 4


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows, starts, lengths, sums, parts, ids = [], [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for row, found in enumerate(encode(texts)):
                found = np.concatenate([found, end])
                for part, low in enumerate(range(0, len(found), capacity)):
                    piece = found[low : low + capacity]
                    rows.append(row)
                    parts.append(part)
                    starts.append(low)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int32())),
                pa.array(parts, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(
        pieces, schema + (", ids array<int>" if with_ids else "")
    )


def _largest(sizes: int, limit: int) -> int:
    """The largest member of a bit set up to ``limit``; 0 if there is none."""
    return (sizes & ((2 << limit) - 1)).bit_length() - 1 if limit > 0 and sizes else 0


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        if room - length:
            by_room[room - length].append(at)
            rooms |= 1 << (room - length)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> tuple[list[list[int]], bool]:
    """One pass of the local search over the underfull bins; also whether anything changed."""
    size = lengths.tolist()
    room = [capacity - sum(size[i] for i in b) for b in bins]
    order = sorted((k for k, r in enumerate(room) if r), key=lambda k: room[k])
    owner: dict[int, int] = {}
    pool: list[set[int]] = [set() for _ in range(capacity + 1)]
    present = 0

    def put(item: int, at: int) -> None:
        nonlocal present
        owner[item] = at
        pool[size[item]].add(item)
        present |= 1 << size[item]

    def take(length: int) -> int:
        nonlocal present
        item = pool[length].pop()
        if not pool[length]:
            present &= ~(1 << length)
        return item

    for k in order:
        for item in bins[k]:
            put(item, k)
    changed = False
    for k in order:
        for item in bins[k]:
            pool[size[item]].discard(item)
            if not pool[size[item]]:
                present &= ~(1 << size[item])
        pairs = True
        while room[k] and present:
            mine = sorted({size[i]: i for i in bins[k]}.items())
            # (room left, items given, lengths received)
            best = (room[k], (), ())
            got = _largest(present, room[k])
            if got > 0:
                best = min(best, (room[k] - got, (), (got,)))
            for a, (length, item) in enumerate(mine):
                if best[0] == 0:
                    break
                free = length + room[k]
                got = _largest(present, free)
                if got > length:
                    best = min(best, (free - got, (item,), (got,)))
                # one of these for two of others
                first = _largest(present, free - 1)
                while pairs and first > 0 and best[0]:
                    second = _largest(present, free - first)
                    if first + second <= length or 2 * first < free:
                        break
                    if second > 0 and (second != first or len(pool[first]) > 1):
                        best = min(best, (free - first - second, (item,), (first, second)))
                    first = _largest(present, first - 1)
                for other_length, other in mine[a + 1 :]:
                    free = length + other_length + room[k]
                    got = _largest(present, free)
                    if got > length + other_length:
                        best = min(best, (free - got, (item, other), (got,)))
            left, given, received = best
            if left >= room[k]:
                break
            items = [take(length) for length in received]
            sources = [owner[i] for i in items]
            for i in items:
                room[owner[i]] += size[i]
            home = max(sources, key=room.__getitem__)
            if room[home] < sum(size[i] for i in given):
                # Two pieces from two sequences, neither of which takes the one given.
                for i in items:
                    room[owner[i]] -= size[i]
                    put(i, owner[i])
                pairs = False
                continue
            changed = True
            for i in items:
                bins[owner[i]].remove(i)
            for i in given:
                bins[k].remove(i)
                bins[home].append(i)
                room[home] -= size[i]
                put(i, home)
            for i in items:
                owner[i] = k
                bins[k].append(i)
            room[k] = left
    return [b for b in bins if b], changed


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per item its bin and its place there; per bin the room left."""
    bins = best_fit(lengths, capacity)
    for _ in range(PASSES):
        bins, changed = improve(bins, lengths, capacity)
        if not changed:
            break
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.zeros(len(bins), np.int64)
    for k, items in enumerate(bins):
        at = 0
        for item in items:
            which[item], offset[item] = k, at
            at += int(lengths[item])
        room[k] = capacity - at
    return which, offset, room


def _packed(pieces: DataFrame, groups: int, capacity: int, nth: int) -> DataFrame:
    """``pieces`` with sequence_id, offset and _room, the room left in the sequence."""

    def pack_group(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        which, offset, room = pack_lengths(lengths, capacity)
        base = (nth << 60) | (table.column("_group")[0].as_py() << 24)
        return (
            table.drop_columns(["_group"])
            .append_column("sequence_id", pa.array(base + which))
            .append_column("offset", pa.array(offset))
            .append_column("_room", pa.array(room[which]))
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return (
        pieces.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(nth)), F.lit(groups)))
        .groupBy("_group")
        .applyInArrow(pack_group, f"{fields}, sequence_id bigint, offset bigint, _room bigint")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``capacity``) with sequence_id and offset."""
    numbered = stored(
        pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "pack-pieces"
    )
    left, done = numbered, None
    for nth in range(ROUNDS):
        groups = -(-left.count() // group_pieces) or 1
        packed = stored(_packed(left, groups, capacity, nth), "pack-packed")
        if groups == 1 or nth == ROUNDS - 1:
            settled, left = packed, None
        else:
            settled = packed.where(F.col("_room") == 0)
            left = packed.where(F.col("_room") > 0).drop("sequence_id", "offset", "_room")
        done = settled if done is None else done.unionByName(settled)
        if left is None:
            break
    return done.drop("_row", "_room")
