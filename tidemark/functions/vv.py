"""Version vectors as canonical ``ARRAY<STRUCT<d STRING, c BIGINT>>``, sorted by ``d``.

Arrays of structs compare lexicographically in Spark, which is the total order used to
break ties. A NULL vector stays NULL; it is not the empty vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import let

VV_TYPE = "array<struct<d:string,c:bigint>>"
LONG_MAX = 9223372036854775807


def vv_entry(device: Column, counter: Column) -> Column:
    return F.struct(device.cast("string").alias("d"), counter.cast("bigint").alias("c"))


def vv_error(entries: Column, manifest: bool = False) -> Column:
    """First broken rule of a list of entries, NULL when it is a valid vector.

    ``manifest`` adds the rules of a stored record: not empty and strictly sorted.
    """
    devices = F.transform(entries, lambda e: e["d"])
    zero = F.exists(entries, lambda e: e["c"] <= 0)
    duplicate = F.size(F.array_distinct(devices)) < F.size(devices)
    rules = F.when(entries.isNull(), F.lit("NULL_VECTOR"))
    if manifest:
        unsorted = F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(devices) - 1, F.lit(1))),
            lambda i: F.coalesce(F.get(devices, i) <= F.get(devices, i - 1), F.lit(False)),
        )
        rules = rules.when(F.size(entries) == 0, F.lit("EMPTY")).when(
            unsorted, F.lit("NOT_STRICTLY_SORTED")
        )
        return rules.when(zero, F.lit("ZERO_COUNTER"))
    return rules.when(zero, F.lit("ZERO_COUNTER")).when(duplicate, F.lit("DUPLICATE_DEVICE"))


def vv_from_entries(entries: Column) -> Column:
    """Canonical vector, or NULL when ``vv_error`` names a broken rule."""
    return F.when(vv_error(entries).isNull(), F.array_sort(entries))


def vv_counter(vv: Column, device: Column) -> Column:
    """Counter of one device, 0 when the vector does not know it."""
    hit = F.get(F.filter(vv, lambda e: e["d"] == device), F.lit(0))
    return F.when(vv.isNotNull(), F.coalesce(hit["c"], F.lit(0).cast("bigint")))


def vv_increment(vv: Column, device: Column) -> Column:
    """Vector with one device's counter raised by one; overflow is an error."""

    def raised(counter: Column) -> Column:
        others = F.filter(vv, lambda e: e["d"] != device)
        return F.array_sort(F.concat(others, F.array(vv_entry(device, counter + F.lit(1)))))

    return let(vv_counter(vv, device), raised)


def _counters(vv: Column) -> Column:
    """Counter by device, or NULL for a list that names a device twice or has none."""
    devices = F.transform(vv, lambda e: e["d"])
    plain = (F.size(F.array_distinct(devices)) == F.size(devices)) & ~F.exists(devices, lambda d: d.isNull())
    return F.when(plain, F.map_from_entries(vv))


def vv_merge(left: Column, right: Column) -> Column:
    """Pointwise maximum of two vectors; NULL when one is NULL or malformed."""
    merged = F.map_zip_with(_counters(left), _counters(right), lambda _, a, b: F.greatest(a, b))
    return F.array_sort(
        F.transform(F.map_entries(merged), lambda e: vv_entry(e["key"], e["value"]))
    )


def vv_collect(df: DataFrame, keys: list[str], device: str = "d", counter: str = "c") -> DataFrame:
    """Fold long-form entries into one vector per key, pointwise maximum.

    Both groupings combine map-side, so a hot key is reduced to its devices before it is
    shuffled; the collected list is as long as the key has devices.
    """
    return (
        df.groupBy(*keys, F.col(device).alias("d"))
        .agg(F.max(counter).cast("bigint").alias("c"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("vv"))
    )


def vv_merge_agg(df: DataFrame, keys: list[str], vv: str = "vv") -> DataFrame:
    """Merge all vectors of a key."""
    entries = df.select(*keys, F.explode(vv).alias("e")).select(*keys, "e.d", "e.c")
    return vv_collect(entries, keys)


def vv_relation(left: Column, right: Column) -> Column:
    """Causal relation of ``left`` to ``right``; a missing device counts as 0.

    NULL when a vector is NULL or malformed.
    """
    gaps = F.map_values(
        F.map_zip_with(
            _counters(left),
            _counters(right),
            lambda _, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)),
        )
    )

    def classify(g: Column) -> Column:
        ahead = F.exists(g, lambda x: x > 0)
        behind = F.exists(g, lambda x: x < 0)
        return (
            F.when(g.isNull(), F.lit(None).cast("string"))
            .when(ahead & behind, F.lit("CONCURRENT"))
            .when(ahead, F.lit("DESCENDANT"))
            .when(behind, F.lit("ANCESTOR"))
            .otherwise(F.lit("EQUAL"))
        )

    return F.when(left.isNotNull() & right.isNotNull(), let(gaps, classify))


def vv_ge(left: Column, left_revision: Column, right: Column, right_revision: Column) -> Column:
    """Total order used to break ties: vector first, revision second."""
    a = F.struct(left.alias("vv"), left_revision.alias("rev"))
    b = F.struct(right.alias("vv"), right_revision.alias("rev"))
    return a >= b


def vv_label(vv: Column) -> Column:
    """``device-`` plus eight characters of the device with the highest counter."""
    top = F.array_max(
        F.transform(vv, lambda e: F.struct(e["c"].alias("c"), e["d"].alias("d")))
    )
    return F.coalesce(
        F.concat(F.lit("device-"), F.substring(F.replace(top["d"], F.lit("-"), F.lit("")), 1, 8)),
        F.lit("device"),
    )


def vv_text(vv: Column) -> Column:
    """``d:c,d:c`` rendering for reports and comparisons."""
    return F.array_join(
        F.transform(vv, lambda e: F.concat(e["d"], F.lit(":"), e["c"].cast("string"))), ","
    )
