"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The distinct vectors are written once, packed into blocks. The covariance matrix is never formed:
everything is learnt from passes over the blocks, each of which multiplies the centred vectors with
a thin matrix Q and adds up XᵀXQ in Spark. A cycle applies a Chebyshev polynomial of the covariance
to a block of directions (one pass per degree), which damps the spectrum below the block's least Ritz value;
then come a QR decomposition and a Rayleigh-Ritz step on the thin matrices. Cycles go on until the
residuals of all wanted components certify them to double precision; certified ones are locked.

Vectors are whole numbers ``floor(scale * c) + offset``, so counts, sums and deviations are exact,
and ``n * x - S`` is centred before anything is rounded. Only matrices of (dimensions x directions),
one per pass, reach the driver; their size does not depend on the rows.

Defined cases: rows without a vector, or with a NULL or non-finite entry, are dropped, and so are those with an
entry beyond 2**40 or of another length than most vectors (the longer one on a tie); repeated rows
count once in the fit and each gets its result; components whose variance is 0 to double precision are left out, so
a table of fewer than two distinct vectors gives none; a deviation beyond 63 bits is NULL; among
equal eigenvalues the components are some orthonormal basis; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
DEGREE = 10
CYCLES = 60
BLOCK_ROWS = 4096
_LARGEST = 1 << 40
_EPS = float(np.finfo(float).eps)
#: A residual this small against the largest eigenvalue certifies a component.
CERTIFIED = 64 * _EPS
#: Largest ratio of what one filter makes of the largest and the least Ritz value.
GROWTH = 1e8
#: Residuals stop shrinking at rounding level; they must have come to this at least.
ACCEPTED = 1e-11


@dataclass
class Whitening:
    """``values`` fall; ``vectors`` has a component per column."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float
    passes: int


def whole_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows with a usable vector."""
    bound = F.lit(float(_LARGEST))

    def usable(c: Column) -> Column:
        # NaN is greater than any bound.
        return c.isNotNull() & (F.abs(c.cast("double") * SCALE) <= bound)

    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    return table.where(F.col(vector).isNotNull() & F.forall(vector, usable)).select(
        F.col(vec_id).alias("vec_id"), x.alias("x")
    )


def _of_common_length(rows: DataFrame) -> tuple[DataFrame, int]:
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = lengths["d"] if lengths else 0
    return rows.where(F.size("x") == dims), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Distinct vectors in blocks of little-endian 64-bit numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims) if dims else np.zeros((0, 0), np.int64)
            parts = [np.ascontiguousarray(x[k : k + BLOCK_ROWS], "<i8").tobytes() for k in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["block"])

    # Copies meet in partial aggregates before the shuffle.
    return stored(rows.select("x").distinct().mapInArrow(pack, "block binary"), "whitening-fit")


def _added(blocks: DataFrame, part, dims: int, width: int) -> np.ndarray:
    """Sum over all blocks of the (dims x width) matrices ``part(x)``.

    Every partition gives one row per dimension; Spark adds them up.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_py(), "<i8").reshape(-1, dims)
                here = part(x)
                total = here if total is None else total + here
        if total is not None:
            places = pa.array(np.arange(total.size), pa.int64())
            yield pa.RecordBatch.from_arrays([places, pa.array(total.ravel())], ["place", "v"])

    whole = part(np.zeros((0, dims), np.int64)).dtype.kind == "i"
    rows = blocks.mapInArrow(partial, f"place bigint, v {'bigint' if whole else 'double'}")
    total = np.zeros(dims * width, np.int64 if whole else float)
    for place, v in rows.groupBy("place").agg(F.sum("v").alias("v")).collect():  # dims * width rows
        total[place] = v
    return total.reshape(dims, width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n``; all of the difference but a fraction is formed in whole numbers."""
    whole, part = np.divmod(sums, n)
    return (x - whole) - part / n


def fit(blocks: DataFrame, dims: int, components: int = COMPONENTS, degree: int = DEGREE, seed: int = 42) -> Whitening:
    """Components of the vectors in ``blocks``."""
    if not dims:
        return Whitening(0, np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 0)), 0.0, 0)
    counted = _added(
        blocks, lambda x: np.stack([x.sum(axis=0), np.full(dims, len(x), np.int64)], axis=1), dims, 2
    )
    n, sums = int(counted[0, 1]), counted[:, 0].copy()
    nothing = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((dims, 0)), 0.0, 1)
    if n < 2:
        return nothing
    trace = float(_added(blocks, lambda x: (_centred(x, n, sums) ** 2).sum(axis=0)[:, None], dims, 1).sum() / n)
    if trace == 0:
        return nothing
    passes = 2

    def covariance_times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return _added(blocks, part, dims, q.shape[1]) / n

    width = min(dims, max(2 * components, components + 8))
    wanted = min(components, dims)
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, width)))[0]
    locked, largest, best = np.zeros((dims, 0)), 0.0, np.inf
    for _ in range(CYCLES):
        q, vq, values = _ritz(q, covariance_times(q))
        largest = max(largest, values[0])
        residuals = np.linalg.norm(vq - q * values, axis=0)[: wanted - locked.shape[1]] / largest
        worst = residuals.max()
        if worst <= CERTIFIED or (worst <= ACCEPTED and worst > best / 4):
            break
        # Components certified already leave the block, or the filter would drown the others in them.
        done = int(np.argmax(residuals > CERTIFIED))
        best = np.inf if done else min(best, worst)
        locked = np.concatenate([locked, q[:, :done]], axis=1)
        q, vq, values = q[:, done:], vq[:, done:], values[done:]
        q = np.linalg.qr(_filtered(covariance_times, locked, q, vq, values, degree))[0]
    else:
        raise ArithmeticError(f"residual {worst} after {CYCLES} cycles")
    q = np.linalg.qr(np.concatenate([locked, q], axis=1))[0]
    q, _, values = _ritz(q, covariance_times(q))

    values, vectors = values[:wanted], q[:, :wanted]
    kept = values > dims * 8 * _EPS * values[0]
    values, vectors = values[kept], vectors[:, kept]
    model = Whitening(n, sums, trace, values, vectors, 0.0, passes)
    model.identity_error = _identity_error(blocks, model, dims)
    return model


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: the basis turned to its Ritz vectors, the same of ``vq``, and falling Ritz values."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return q @ turn, vq @ turn, values[::-1]


def _filtered(times, locked: np.ndarray, q: np.ndarray, vq: np.ndarray, values: np.ndarray, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance applied to ``q``, small on [0, least Ritz value].

    The recurrence is scaled so that the largest Ritz value maps to 1; ``vq`` saves its first pass.
    The degree is lowered where the largest value would outgrow the least beyond GROWTH, and
    locked components are taken out of every step.
    """

    def without_locked(y: np.ndarray) -> np.ndarray:
        return y - locked @ (locked.T @ y)

    low = max(values[-1], _EPS * values[0])
    half = centre = low / 2
    if values[0] <= low * (1 + 1e-12):  # a flat spectrum: every basis of the block will do
        return without_locked(vq)
    degree = max(1, min(degree, int(np.log(GROWTH) / np.arccosh((values[0] - centre) / half))))
    sigma = first = half / (values[0] - centre)
    before, now = q, without_locked(vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, without_locked(times(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return without_locked(now)


def _identity_error(blocks: DataFrame, model: Whitening, dims: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.values)
    pad = dims - k

    def projected(x: np.ndarray) -> np.ndarray:
        return _centred(x, model.n, model.sums) @ model.vectors / np.sqrt(model.values)

    mean = _added(blocks, lambda x: np.pad(projected(x).sum(axis=0), (0, pad))[:, None], dims, 1)[:k, 0] / model.n

    def part(x: np.ndarray) -> np.ndarray:
        w = projected(x) - mean
        return np.pad(w.T @ w, ((0, pad), (0, 0)))

    return float(np.abs(_added(blocks, part, dims, k)[:k] / model.n - np.eye(k)).max()) if k else 0.0


_ROW = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row per vector and component."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    dims, k = model.vectors.shape
    if not k:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {_ROW}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            centred = _centred(x, model.n, model.sums)
            moved = model.n * x - model.sums
            deviation = (moved * moved).sum(axis=1)
            fits = ((centred * model.n) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            whitened = centred @ model.vectors / np.sqrt(model.values)
            count, rows_of = len(x), np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(rows_of)),
                pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()),
                pa.array(np.full(count * k, model.n), pa.int64()),
                pa.array(deviation[rows_of], pa.int64(), mask=~fits[rows_of]),
                pa.array(whitened.ravel(), pa.float64()),
                pa.array(np.tile(model.values / model.trace, count), pa.float64()),
                pa.array(np.full(count * k, model.identity_error), pa.float64()),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(apply, f"vec_id {kind}, {_ROW}")


def whiten(
    table: DataFrame,
    components: int = COMPONENTS,
    degree: int = DEGREE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of all usable rows."""
    rows, dims = _of_common_length(whole_vectors(table, vec_id, vector))
    return project(rows, fit(_blocks(rows, dims), dims, components, degree))
