"""Dense ranks and per-key top-n without a window over an unbounded group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_ready, materialized

# A bucket covers 2**16 consecutive order values. Order values are unique inside a group, so
# no bucket, and no parent of buckets one level up, can hold more than 65,536 rows.
BUCKET_BITS = 16
LEVELS = 3
# Groups of at most so many rows are ranked by one window each.
GROUP_ROWS = 1 << BUCKET_BITS
# Rows of whole groups that one task sorts, whatever the session's number of shuffle partitions.
TASK_ROWS = 1 << 18
# The bucket of NULL orders, before all others.
NULL_BUCKET = -(1 << 60)


def order_bucket(order: str) -> Column:
    return F.shiftright(F.col(order).cast("bigint"), BUCKET_BITS)


def rows_before(counts: DataFrame, by: list[str], bucket: str, count: str = "n", level: int = 1) -> DataFrame:
    """Add ``before``: how many rows of the group sit in smaller buckets.

    Buckets are summed under their parents (the same bits again), so every window spans at
    most 65,536 rows however many buckets there are.
    """
    window = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if level == LEVELS:
        partition = [F.col(c) for c in by] or [F.lit(0)]
        local = F.sum(count).over(window.partitionBy(*partition))
        return counts.withColumn("before", F.coalesce(local, F.lit(0)))
    parent = f"{bucket}_p"
    counts = counts.withColumn(parent, F.shiftright(bucket, BUCKET_BITS))
    parents = rows_before(
        counts.groupBy(*by, parent).agg(F.sum(count).alias(count)), by, parent, count, level + 1
    )
    parents = parents.select(*by, parent, F.col("before").alias("before_parent"))
    local = F.coalesce(F.sum(count).over(window.partitionBy(*by, parent)), F.lit(0))
    return (
        join_on_keys(counts.withColumn("before", local), parents, [*by, parent])
        .withColumn("before", F.col("before") + F.col("before_parent"))
        .drop(parent, "before_parent")
    )


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which NULL keys are equal; the keys of ``left`` stay."""
    if not keys:
        return left.crossJoin(right)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def dense_rank(
    df: DataFrame,
    order: str,
    by: list[str] | None = None,
    out: str = "rank",
    ties: list[str] | None = None,
) -> DataFrame:
    """1-based rank of each row in ``order`` inside its ``by`` group.

    ``order`` is a BIGINT, unique in the group, or a prefix of the real order with the rest
    in ``ties``; NULL comes first. Most groups are small and take one window each. Those of more than ``GROUP_ROWS``
    rows, and a table that is one group, are cut into buckets of order values: the buckets are counted, and the
    rows ranked inside their bucket. A retried task gives the same ranks. With ``ties`` a bucket holds as many rows as
    share 65,536 order values.
    """
    by, ties = by or [], ties or []
    if not by:
        return _bucketed_rank(df, order, by, out, ties)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    is_large = F.col("n") > GROUP_ROWS
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(is_large).alias("large")).first()
    tasks = task_count(df, total["rows"])
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(order, *ties)).cast("bigint")
    if not total["large"]:
        return df.repartition(tasks, *by).withColumn(out, inside)
    large = materialized(counts.where(is_large).select(*[F.col(c).alias(f"_large_{c}") for c in by]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_large_{c}")) for c in by])
    cut = _bucketed_rank(df.join(large, same, "left_semi"), order, by, out, ties)
    return df.join(large, same, "left_anti").repartition(tasks, *by).withColumn(out, inside).unionByName(cut)


def task_count(df: DataFrame, rows: int) -> int:
    """Tasks for ``rows`` rows: at most some ``TASK_ROWS`` each, and no core without one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _bucketed_rank(df: DataFrame, order: str, by: list[str], out: str, ties: list[str]) -> DataFrame:
    checkpoint_ready(df.sparkSession)
    bucketed = df.withColumn("_b", F.coalesce(order_bucket(order), F.lit(NULL_BUCKET)))
    counts = bucketed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    before = rows_before(counts, by, "_b").select(*by, "_b", "before")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order, *ties))
    return (
        join_on_keys(bucketed, before, [*by, "_b"])
        .withColumn(out, F.col("before") + inside)
        .drop("_b", "before")
    )


def hex_order(digest: Column, digits: int = 8) -> Column:
    """Leading hex digits as a number: an order-preserving, evenly spread bucket source."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def top_per_key(df: DataFrame, keys: list[str], order: list[str], n: int, salt: str, salts: int = 64) -> DataFrame:
    """First ``n`` rows of each key in ``order``.

    A hot key is cut into ``salts`` parts first; each part keeps its own first ``n`` rows,
    so the last window sees at most ``salts * n`` rows of a key.
    """
    if n <= 0:
        return df.where(F.lit(False))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    part = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    kept = salted.withColumn("_rn", part).where(F.col("_rn") <= n).drop("_rn", "_salt")
    whole = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return kept.withColumn("position", whole).where(F.col("position") <= n)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    out: str = "previous",
    cell_rows: int = 1 << BUCKET_BITS,
) -> DataFrame:
    """Add the struct of ``columns`` of the row before, per key in ``order`` (NULL: first row).

    ``order`` is unique in the key and not NULL. Keys are cut into cells of ``cell_rows`` order
    values: rows look back inside their cell, and only the last row of each cell is handed to
    the next.
    """
    value = F.struct(order, *columns)
    cells = df.withColumn("_cell", F.floor(F.col(order) / cell_rows))
    last = cells.groupBy(*keys, "_cell").agg(F.max_by(value, order).alias("_last"))
    handed = last.select(
        *keys, "_cell", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cell")).alias("_handed")
    )
    inside = F.lag(value).over(Window.partitionBy(*keys, "_cell").orderBy(order))
    return (
        join_on_keys(cells, handed, [*keys, "_cell"])
        .withColumn(out, F.coalesce(inside, F.col("_handed")))
        .drop("_cell", "_handed")
    )
