"""Ranks inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 1 << 16


def id_hash(column: Column | str) -> Column:
    """32 evenly spread bits of an id (NULL counts as empty)."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def cell_count(rows: int) -> int:
    return max(1, rows // CELL_ROWS)


def rank_in_cells(
    df: DataFrame, by: list[str], coarse: str, cell: str, within: list[Column], out: str
) -> DataFrame:
    """0-based rank in each ``by`` group, in the order (``coarse``, ``cell``, ``within``).

    A window spans one cell (some 65,536 rows when cells come from ``id_hash`` modulo
    ``cell_count``), the cells of one coarse value, or the coarse values of a group; no window
    spans a group's rows. ``by``, ``coarse`` and ``cell`` must not be NULL.
    """
    counts = df.groupBy(*by, coarse, cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    of_group = [F.col(c) for c in by] or [F.lit(0)]
    coarser = (
        counts.groupBy(*by, coarse)
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_above", F.sum("_n").over(before.partitionBy(*of_group).orderBy(coarse)))
        .drop("_n")
    )
    cells = (
        counts.withColumn("_before", F.sum("_n").over(before.partitionBy(*by, coarse).orderBy(cell)))
        .join(coarser, [*by, coarse])
        .select(
            *by,
            coarse,
            cell,
            (F.coalesce("_before", F.lit(0)) + F.coalesce("_above", F.lit(0))).alias("_offset"),
        )
    )
    inside = F.row_number().over(Window.partitionBy(*by, coarse, cell).orderBy(*within))
    return (
        df.join(cells, [*by, coarse, cell])
        .withColumn(out, F.col("_offset") + inside - 1)
        .drop("_offset")
    )
