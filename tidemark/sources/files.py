"""Directory listings and file contents as DataFrames.

Spark's own file sources leave out names that start with ``.`` or ``_``; a snapshot of a
folder has to list them, so directories are walked by tasks, one level per job.
"""

from __future__ import annotations

import os
from urllib.parse import unquote
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import normalize_paths, path_error
from tidemark.operators.chunking import DEFAULT_SIZES, WINDOW, candidates, cut_points, size_error
from tidemark.operators.ranking import union_all
from tidemark.session import checkpoint_ready

ENTRY = "path string, is_dir boolean, length bigint, mtime_ms bigint, error string"
ROWS = 10_000


def _local(root: str) -> str:
    """A ``file:`` address as the path it names; anything else as it is."""
    if root.startswith("file:"):
        return "/" + unquote(root[len("file:") :]).lstrip("/")
    return root


def _entries(root: str, directory: str) -> Iterator[tuple]:
    """Regular files and sub-directories of one directory; links are not followed."""
    root = _local(root)
    prefix = f"{directory}/" if directory else ""
    if "://" in root:
        fs, base = pafs.FileSystem.from_uri(root)
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/{directory}".rstrip("/"))):
            if info.type == pafs.FileType.Directory:
                yield prefix + info.base_name, True, None, None, None
            elif info.type == pafs.FileType.File:
                mtime = info.mtime_ns // 1_000_000 if info.mtime_ns is not None else None
                yield prefix + info.base_name, False, info.size, mtime, None
        return
    with os.scandir(os.path.join(root, directory)) as found:
        for entry in found:
            if entry.is_symlink():
                continue
            if entry.is_dir(follow_symlinks=False):
                yield prefix + entry.name, True, None, None, None
            elif entry.is_file(follow_symlinks=False):
                stat = entry.stat(follow_symlinks=False)
                yield prefix + entry.name, False, stat.st_size, stat.st_mtime_ns // 1_000_000, None


def _lister(root: str):
    columns = ["path", "is_dir", "length", "mtime_ms", "error"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"length": "Int64", "mtime_ms": "Int64", "is_dir": "boolean"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for directory in batch["path"]:
                rows: list[tuple] = []
                try:
                    for row in _entries(root, directory):
                        rows.append(row)
                        if len(rows) >= ROWS:
                            yield frame(rows)
                            rows = []
                except OSError as problem:
                    rows.append((directory, None, None, None, f"WALK_ERROR: {problem.strerror}"))
                if rows:
                    yield frame(rows)

    return run


def list_files(spark: SparkSession, root: str, ordered: bool = False) -> DataFrame:
    """Regular files under ``root``: ``path, length, mtime_ms, display, path_key, path_error``.

    Paths are relative to ``root``, which must be visible to the executors. A directory that
    cannot be read shows as a row with an error, which ``diff_gate`` turns into a refusal of
    the whole snapshot. Contents are not read; see ``read_contents`` and ``chunk_files``.
    ``ordered`` sorts by display path; nothing else here needs the order.
    """
    checkpoint_ready(spark)
    root = root.rstrip("/")
    level = spark.createDataFrame([("",)], "path string")
    files = []
    while True:
        found = level.mapInPandas(_lister(root), ENTRY).checkpoint()
        files.append(found.where(F.coalesce(~F.col("is_dir"), F.lit(True))))
        folders = found.where(F.col("is_dir")).select("path")
        if folders.isEmpty():
            break
        level = folders.repartition("path")
    rows = union_all(*files).drop("is_dir").repartition("path")
    named = normalize_paths(rows, "path")
    checked = named.withColumn("path_error", F.coalesce("error", path_error(F.col("display")))).drop("error")
    return checked.orderBy("display") if ordered else checked


def _open(root: str, path: str):
    root = _local(root)
    if "://" in root:
        fs, base = pafs.FileSystem.from_uri(root)
        return fs.open_input_stream(f"{base}/{path}")
    return open(os.path.join(root, path), "rb")


def _read_range(root: str, path: str, offset: int, size: int) -> bytes:
    root = _local(root)
    if "://" in root:
        fs, base = pafs.FileSystem.from_uri(root)
        with fs.open_input_file(f"{base}/{path}") as source:
            return source.read_at(size, offset)
    with open(os.path.join(root, path), "rb") as source:
        source.seek(offset)
        return source.read(size)


def read_contents(listing: DataFrame, root: str) -> DataFrame:
    """Whole content of each listed file, for files that fit one value (2 GiB).

    A file that cannot be read any more has a row with ``error`` and no content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                content, error = None, None
                try:
                    with _open(root, path) as source:
                        content = source.read()
                except OSError as problem:
                    error = f"READ_ERROR: {problem.strerror or problem}"
                yield pd.DataFrame({"path": [path], "content": [content], "error": [error]})

    return listing.select("path").mapInPandas(run, "path string, content binary, error string")


def chunk_files(
    listing: DataFrame,
    root: str,
    minimum: int = DEFAULT_SIZES[0],
    average: int = DEFAULT_SIZES[1],
    maximum: int = DEFAULT_SIZES[2],
    block: int = 8 * 1024 * 1024,
) -> DataFrame:
    """Chunks of each listed file, read as a stream: ``path, chunk_index, offset, size, payload, error``.

    At most ``block`` and one chunk of a file are in memory. The cuts are those ``cdc_chunk``
    makes on the whole content. A file that cannot be read (to its end) has a last row with
    ``error`` and no payload, so its chunks are known to be incomplete.
    """
    problem = size_error(minimum, average, maximum)
    if problem:
        raise ValueError(problem)
    block = max(block, 2 * maximum)

    def pieces(path: str) -> Iterator[tuple[int, bytes]]:
        import numpy as np

        offset, held, last = 0, b"", False
        with _open(root, path) as source:
            while not last:
                more = source.read(block)
                last = not more
                held += more
                if not held:
                    return
                ends = cut_points(
                    np.array([0, len(held)]), np.frombuffer(held, np.uint8), (minimum, average, maximum)
                )[0]
                start = 0
                for end in ends:
                    # A cut is final once a whole maximum-size chunk could have followed it.
                    if not last and len(held) - start < maximum:
                        break
                    yield offset + start, held[start:end]
                    start = end
                offset += start
                held = held[start:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "chunk_index", "offset", "size", "payload", "error"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, t) for column, t in zip(zip(*rows), types)], names=names
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                try:
                    for index, (offset, data) in enumerate(pieces(path)):
                        rows.append((path, index, offset, len(data), data, None))
                        size += len(data)
                        if size >= block:
                            yield pack(rows)
                            rows, size = [], 0
                except OSError as problem:
                    rows.append((path, None, None, None, None, f"READ_ERROR: {problem.strerror or problem}"))
                if rows:
                    yield pack(rows)

    schema = "path string, chunk_index bigint, offset bigint, size bigint, payload binary, error string"
    return listing.select("path").mapInArrow(run, schema)


CUT = "path string, chunk_index bigint, offset bigint, size bigint, error string"
_END, _LOOSE, _STRICT = 2, 0, 1


def chunk_blocks(
    listing: DataFrame,
    root: str,
    minimum: int = DEFAULT_SIZES[0],
    average: int = DEFAULT_SIZES[1],
    maximum: int = DEFAULT_SIZES[2],
    block: int = 32 * 1024 * 1024,
) -> DataFrame:
    """Cuts of each listed file, one file in many tasks: ``path, chunk_index, offset, size, error``.

    Blocks are read side by side, each with the bytes a hash window reaches back, and give the places
    where a cut may fall: two numbers for every ``average`` bytes or so. One pass over a file's places in their
    order, as a stream that remembers the open chunk only, picks the cuts ``cdc_chunk`` makes on the whole
    content. A file with a block that cannot be read, or that is shorter than listed, has one row with
    ``error`` and no chunks; a row of the listing without a length has none; rows listed twice count once.
    """
    problem = size_error(minimum, average, maximum)
    if problem:
        raise ValueError(problem)
    names = ["path", "at", "kind", "error"]
    kinds = [pa.string(), pa.int64(), pa.int8(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows(path, at, kind, error=None):
            columns = [[path] * len(at), at, kind, [error] * len(at)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for path, length, start in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start"))):
                if start == 0:
                    yield rows(path, [length], [_END])
                low = max(start - (WINDOW - 1), 0)
                high = min(start + block, length)
                try:
                    data = _read_range(root, path, low, high - low)
                    error = None if len(data) == high - low else "READ_ERROR: shorter than listed"
                except OSError as failure:
                    error = f"READ_ERROR: {failure.strerror or failure}"
                if error:
                    yield rows(path, [-1], [_END], error)
                    continue
                strict, loose = (found + low for found in candidates(np.frombuffer(data, np.uint8), average))
                loose = loose[loose > start]
                yield rows(path, loose, np.isin(loose, strict, assume_unique=True).astype(np.int8))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = ["path", "chunk_index", "offset", "size", "error"]
        path, start, index, failed, out = None, 0, 0, False, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=columns)

        for batch in batches:
            for mine, at, kind, error in zip(*(batch.column(c).to_pylist() for c in names)):
                if mine != path:
                    path, start, index, failed = mine, 0, 0, False
                if error and not failed:
                    failed = True
                    out.append((path, None, None, None, error))
                if failed:
                    continue
                while at - start > maximum:
                    out.append((path, index, start, maximum, None))
                    start, index = start + maximum, index + 1
                    if len(out) >= ROWS:
                        yield packed()
                        out = []
                far = at - start
                if far and (kind == _END or far >= average or (kind == _STRICT and far >= minimum)):
                    out.append((path, index, start, far, None))
                    start, index = at, index + 1
            if out:
                yield packed()
                out = []

    files = listing.where(F.col("length").isNotNull()).groupBy("path").agg(F.max("length").alias("length"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest("length", F.lit(1)) - 1, F.lit(block).cast("bigint"))
    blocks = files.select("path", "length", F.explode(starts).alias("start")).repartition("path", "start")
    places = blocks.mapInArrow(scan, "path string, at bigint, kind tinyint, error string")
    # Errors are at -1, so they come before everything else of their file.
    ordered = places.repartition("path").sortWithinPartitions("path", "at", "kind")
    return ordered.mapInArrow(choose, CUT)


def chunk_payloads(cuts: DataFrame, root: str, block: int = 32 * 1024 * 1024) -> DataFrame:
    """``cuts`` of ``chunk_blocks`` with their bytes, read by as many tasks as there are blocks of ``block`` bytes.

    A range that cannot be read any more has ``error`` and no payload; rows with an error keep it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                path, _, offset, size, error = (c[0].as_py() for c in row.columns)
                data = None
                if error is None:
                    try:
                        data = _read_range(root, path, offset, size)
                        if len(data) < size:
                            data, error = None, "READ_ERROR: shorter than listed"
                    except OSError as failure:
                        error = f"READ_ERROR: {failure.strerror or failure}"
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:4], pa.array([error], pa.string()), pa.array([data], pa.binary())],
                    names=[*batch.schema.names, "payload"],
                )

    columns = [c.split()[0] for c in CUT.split(", ")]
    spread = cuts.select(*columns).repartition("path", F.floor(F.col("offset") / block))
    return spread.mapInArrow(run, CUT + ", payload binary")
