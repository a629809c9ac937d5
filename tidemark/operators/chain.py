"""Compare-and-swap chains without stepping through a key's rows.

A proposal can commit only on the value it expects, so every committed row has one possible
successor: the next row of the key that expects the row's value. Whether a row commits is whether
it can be reached from the key's first head along these successors. Successors lie behind their rows, so rows are
cut into ranges of (key, order): inside a range, paths are followed in one task; between ranges only the rows
that a pointer from another range leads to are left, and doubling the length of their pointers finds those that are
reached in about log2 of the number of ranges, however the rows are spread over keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import join_on_keys
from tidemark.session import discard, materialized

CELL_ROWS = 1 << 16
# Rows of a range whose paths one task follows.
RANGE_ROWS = 1 << 18


def next_match(
    nodes: DataFrame, matches: DataFrame, keys: list[str], order: str, out: str, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``nodes`` (``keys``, ``order``) with ``out``: the least ``order`` of a row of ``matches`` behind it, same ``keys``.

    Both are cut into cells of ``cell_rows`` order values; a window spans a cell, or the cells of
    one key.
    """
    columns = [F.col(c) for c in keys]
    cell = F.floor(F.col(order) / cell_rows).alias("_cell")
    both = nodes.select(*columns, order, cell, F.lit(None).cast("bigint").alias("_match")).unionByName(
        matches.select(*columns, order, cell, F.col(order).alias("_match"))
    )
    behind = Window.partitionBy(*keys, "_cell").orderBy(order).rangeBetween(1, Window.unboundedFollowing)
    inside = both.withColumn("_inside", F.min("_match").over(behind))
    later = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    beyond = both.groupBy(*keys, "_cell").agg(F.min("_match").alias("_least")).select(
        *columns, "_cell", F.min("_least").over(later).alias("_beyond")
    )
    return join_on_keys(inside.where(F.col("_match").isNull()), beyond, [*keys, "_cell"]).select(
        *columns, order, F.coalesce("_inside", "_beyond").alias(out)
    )


def reachable(pointers: DataFrame, starts: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows (keys, ``at``) on the paths from ``starts``, and the rounds it took.

    ``pointers``: keys, ``at``, ``to``. After round r everything within 2**r steps is reached.
    """
    reached = materialized(starts.select(*keys, "at"))
    jumps = materialized(pointers.where(F.col("to").isNotNull()).select(*keys, "at", "to"))
    rounds = 0
    while not jumps.isEmpty():
        rounds += 1
        step = join_on_keys(reached, jumps, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        further = materialized(reached.unionByName(step).distinct())
        onward = jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("_to"))
        longer = materialized(
            join_on_keys(jumps, onward, [*keys, "to"]).select(*keys, "at", F.col("_to").alias("to"))
        )
        discard(reached, jumps)
        reached, jumps = further, longer
    discard(jumps)
    return reached, rounds


def reachable_forward(
    pointers: DataFrame, starts: DataFrame, keys: list[str], range_rows: int | None = None
) -> tuple[DataFrame, int]:
    """``reachable`` where ``at`` is a BIGINT, unique in the key, and ``to`` is larger; each row once.

    ``pointers`` also holds the rows without successor (``to`` NULL): a row it does not hold is not reached.
    """
    size = range_rows or RANGE_ROWS
    kept = materialized(pointers.select(*keys, "at", "to"))
    ranges = max(1, -(-kept.count() // size))
    kinds = [f"`{c}` {t}" for c, t in kept.select(*keys).dtypes]
    ordered = kept.repartitionByRange(ranges, *keys, "at").sortWithinPartitions(*keys, "at")
    schema = ", ".join([*kinds, "at bigint, exit bigint, place int, next int, part int"])
    cut = materialized(ordered.mapInArrow(lambda tables: _exits(tables, keys), schema))
    discard(kept)
    # A path enters a range at its start or where a pointer leads to from another range.
    begun = starts.select(*keys, "at")
    entries = begun.unionByName(cut.where(F.col("exit").isNotNull()).select(*keys, F.col("exit").alias("at"))).distinct()
    entered = materialized(join_on_keys(cut, entries, [*keys, "at"]).select(*keys, "at", F.col("exit").alias("to"), "part", "place"))
    reached, rounds = reachable(entered, begun, keys)
    met = join_on_keys(entered, reached, [*keys, "at"]).select("part", "place")
    out = ", ".join([*kinds, "at bigint"])
    paths = cut.groupBy("part").cogroup(met.groupBy("part"))
    return paths.applyInArrow(lambda rows, first: _paths(rows, first, keys), out), rounds


def _exits(tables: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted, with ``next``, the place of the successor in the range (-1: none), and ``exit``, where the path leaves it."""
    batches = list(tables)
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    n = rows.num_rows
    if not n:
        return
    changed = np.zeros(n, dtype=bool)
    for key in keys:
        column = pa.concat_arrays(rows[key].chunks)
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    run = np.cumsum(changed)
    at = rows["at"].to_numpy()
    goes = pc.is_valid(rows["to"]).to_numpy()
    to = np.where(goes, pc.fill_null(rows["to"], 0).to_numpy(), at)
    values = np.unique(np.concatenate([at, to]))
    node = run * len(values) + np.searchsorted(values, at)
    wanted = run * len(values) + np.searchsorted(values, to)
    place = np.minimum(np.searchsorted(node, wanted), n - 1)
    inside = goes & (node[place] == wanted)
    following = np.where(inside, place, -1)
    last = _ends(following)
    leaving = pa.array(to[last], mask=~goes[last])
    part = np.full(n, TaskContext.get().partitionId(), dtype=np.int32)
    done = pa.Table.from_arrays(
        [*(rows[key] for key in keys), rows["at"], leaving, pa.array(np.arange(n, dtype=np.int32)), pa.array(following.astype(np.int32)), pa.array(part)],
        names=[*keys, "at", "exit", "place", "next", "part"],
    )
    yield from done.to_batches(max_chunksize=1 << 16)


def _ends(following: np.ndarray) -> np.ndarray:
    """The last place of the path from each place."""
    end = np.where(following < 0, np.arange(len(following)), following)
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return end
        end = further


def _paths(rows: pa.Table, first: pa.Table, keys: list[str]) -> pa.Table:
    """Rows of one range on the paths from the places in ``first``."""
    # Rows come in any order; their place is known.
    slot = rows["place"].to_numpy()
    jump = np.empty(len(slot), dtype=np.int64)
    jump[slot] = rows["next"].to_numpy()
    jump = np.where(jump < 0, np.arange(len(jump)), jump)
    on_path = np.zeros(len(jump), dtype=bool)
    on_path[first["place"].to_numpy()] = True
    while True:
        on_path[jump[on_path]] = True
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    return rows.select([*keys, "at"]).filter(pa.array(on_path[slot]))


def last_marked(
    rows: DataFrame, keys: list[str], order: str, marked: Column, value: Column, out: str, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Add ``out``: ``value`` of the last marked row before, per key in ``order``."""
    cells = rows.withColumn("_cell", F.floor(F.col(order) / cell_rows)).withColumn("_value", F.when(marked, value))
    last = cells.groupBy(*keys, "_cell").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(*keys, "_cell", F.last("_last", ignorenulls=True).over(before).alias("_handed"))
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    found = cells.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    return (
        join_on_keys(found, handed, [*keys, "_cell"])
        .withColumn(out, F.coalesce("_inside", "_handed"))
        .drop("_cell", "_value", "_inside", "_handed")
    )


def committed_rows(proposals: DataFrame, heads: DataFrame, keys: list[str], order: str, blocked: Column) -> tuple[DataFrame, int]:
    """(keys, ``order``) of the proposals that commit, and the rounds it took."""
    able = proposals.where(~blocked & ~F.col("content_id").eqNullSafe(F.col("expected_previous")))
    able = materialized(able.select(*keys, order, "content_id", "expected_previous"))
    first = able.groupBy(*keys).agg((F.min(order) - 1).alias(order))
    # Content of the head of each key; a key without a head starts from NULL.
    held = heads.select(*keys, F.col("content_id").alias("_value"))
    renamed = held.withColumnsRenamed({k: f"_head_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_head_{k}")) for k in keys])
    starts = materialized(first.join(renamed, same, "left").select(*keys, order, "_value"))
    nodes = able.select(*keys, order, F.col("content_id").alias("_value")).unionByName(starts)
    wanted = able.select(*keys, order, F.col("expected_previous").alias("_value"))
    pointers = next_match(nodes, wanted, [*keys, "_value"], order, "to").select(
        *keys, F.col(order).alias("at"), "to"
    )
    reached, rounds = reachable_forward(pointers, starts.select(*keys, F.col(order).alias("at")), keys)
    # The start of a key is no row.
    rows = join_on_keys(reached.withColumnRenamed("at", order), first.withColumnRenamed(order, "_start"), keys)
    return rows.where(F.col(order) > F.col("_start")).drop("_start"), rounds
