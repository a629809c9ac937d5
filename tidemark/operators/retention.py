"""Reference counts, garbage collection and audits of the object catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import first_status, object_key
from tidemark.operators.ranking import union_all
from tidemark.session import discard, materialized
from tidemark.sources.keyed import KeyedTable


def reference_counts(
    objects: DataFrame,
    changes: DataFrame | None = None,
    edges: DataFrame | None = None,
    heads: DataFrame | None = None,
    pending: DataFrame | None = None,
    provenance: DataFrame | None = None,
) -> DataFrame:
    """Objects with the number of rows that pin them.

    Changes, heads and provenance pin by ``content_id``, pending targets by
    ``target_content_id`` and edges (a set of ``owner_id, content_id``) the referenced id.
    Counts combine map-side, so a popular object costs one row per task. Where the catalog has
    groups, a row pins the object of its own group.
    """
    key = object_key(objects, *[f for f in (changes, edges, heads, pending, provenance) if f is not None])
    group = key[:-1]
    pins = []
    for frame, column in (
        (changes, "content_id"),
        (heads, "content_id"),
        (provenance, "content_id"),
        (pending, "target_content_id"),
    ):
        if frame is not None:
            pins.append(frame.select(*group, F.col(column).alias("content_id")))
    if edges is not None:
        pins.append(edges.select("owner_id", *key).distinct().select(*key))
    if not pins:
        return objects.withColumn("reference_count", F.lit(0).cast("bigint"))
    counts = union_all(*pins).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return objects.join(counts, key, "left").withColumn(
        "reference_count", F.coalesce("_n", F.lit(0))
    ).drop("_n")


def pin_deltas(events: DataFrame) -> DataFrame:
    """(content_id, n), per group where ``events`` has groups, by which pins change the counts.

    ``events``: ``old_content_id`` (NULL: inserted) and ``new_content_id`` (NULL: deleted) of every
    row of a pinning table that changed; a head that moves is both. Edges are a set: an event is
    an edge that is new or gone.
    """
    group = ["group_id"] if "group_id" in events.columns else []
    signed = F.array(
        F.struct(F.col("old_content_id").alias("content_id"), F.lit(-1).cast("bigint").alias("n")),
        F.struct(F.col("new_content_id").alias("content_id"), F.lit(1).cast("bigint").alias("n")),
    )
    return (
        events.select(*group, F.inline(signed))
        .where(F.col("content_id").isNotNull())
        .groupBy(*group, "content_id")
        .agg(F.sum("n").alias("n"))
        .where("n <> 0")
    )


def maintain_counts(counts: KeyedTable, events: DataFrame) -> int:
    """Add a batch of pin changes to stored counts (``content_id, n``); the new version.

    Only the buckets of changed ids are read and written. Ids nothing pins any more are left out.
    """
    deltas = materialized(pin_deltas(events))
    key = [c for c in deltas.columns if c != "n"]

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0")

    version = counts.change(deltas, merged)
    discard(deltas)
    return version


def counted_objects(objects: DataFrame, counts: KeyedTable) -> DataFrame:
    """``reference_counts`` from maintained counts."""
    found = objects.join(counts.read(), object_key(objects), "left")
    return found.withColumn("reference_count", F.coalesce("n", F.lit(0))).drop("n")


def gc_candidates(counted: DataFrame, cutoff_ms: int, n: int) -> DataFrame:
    """Up to ``n`` unreferenced objects last verified by ``cutoff_ms``, oldest first."""
    if n <= 0:
        return counted.where(F.lit(False))
    return (
        counted.where((F.col("reference_count") == 0) & (F.col("verified_at_ms") <= cutoff_ms))
        .orderBy("verified_at_ms", "content_id")
        .limit(n)
    )


def gc_report(removed: DataFrame) -> DataFrame:
    return removed.agg(
        F.count(F.lit(1)).alias("removed_objects"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("removed_bytes"),
    )


def gc_sweep(objects: DataFrame, roots: DataFrame, edges: DataFrame, cutoff_ms: int | None = None) -> DataFrame:
    """Objects no root reaches: repeated passes would end by removing exactly these.

    The graph is two levels deep (roots own chunks), so one semi join marks everything. Where the
    catalog has groups, a root reaches objects of its own group.
    """
    key = object_key(objects, roots, edges)
    group = key[:-1]
    alive = roots.select(*key).distinct()
    owners = alive.select(*group, F.col("content_id").alias("owner_id"))
    owned = edges.join(owners, [*group, "owner_id"], "left_semi")
    marked = alive.unionByName(owned.select(*key)).distinct()
    old = objects if cutoff_ms is None else objects.where(F.col("verified_at_ms") <= cutoff_ms)
    return old.join(marked, key, "left_anti")


def audit_catalog(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalog rows against stored bytes.

    ``DEMOTE``: marked available but the bytes are gone (row and references stay).
    ``ORPHAN``: bytes without a row. ``ABSENT``: known to be unavailable. ``OK`` otherwise.
    """
    key = object_key(catalog, listing)
    files = listing.select(*key, F.col("length").alias("stored_bytes"))
    rows = catalog.select(*key, F.col("available").alias("was_available"))
    joined = rows.join(files, key, "full_outer")
    stored = F.col("stored_bytes").isNotNull()
    return joined.withColumn(
        "status",
        first_status(
            (F.col("was_available").isNull(), "ORPHAN"),
            (F.col("was_available") & ~stored, "DEMOTE"),
            (~F.col("was_available") & ~stored, "ABSENT"),
            otherwise="OK",
        ),
    ).withColumn("available", F.coalesce("was_available", F.lit(False)) & stored)


def demote(catalog: DataFrame, audit: DataFrame) -> DataFrame:
    """Catalog with the demotions of an audit applied; every row is kept."""
    key = object_key(catalog, audit)
    lost = audit.where(F.col("status") == "DEMOTE").select(*key, F.lit(True).alias("_lost"))
    return catalog.join(lost, key, "left").withColumn(
        "available", F.col("available") & F.col("_lost").isNull()
    ).drop("_lost")


def audit_transfers(transfers: DataFrame, listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Open transfers against the bytes on disk: what to keep, adopt or drop."""
    keys = keys or ["peer", "content_id"]
    rows = transfers.select(*keys, F.col("size").alias("expected"), "received", F.lit(True).alias("_row"))
    files = listing.select(*keys, F.col("length").alias("actual"))
    joined = rows.join(files, keys, "full_outer")
    return joined.withColumn(
        "status",
        first_status(
            (F.col("_row").isNull(), "ORPHAN"),
            (F.col("actual").isNull(), "DROP_ABSENT"),
            (F.col("actual") > F.col("expected"), "DROP_OVERSIZED"),
            (F.col("actual") != F.col("received"), "ADOPT_ACTUAL"),
            otherwise="OK",
        ),
    ).withColumn(
        "received_after", F.when(F.col("status").isin("OK", "ADOPT_ACTUAL"), F.col("actual"))
    ).drop("_row")
