"""Snapshot diff: stored heads against a listing of the files that exist now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.vv import vv_entry, vv_increment
from tidemark.operators.ranking import union_all

COMPARED = ["display", "size", "mtime_ms", "chunks_digest"]


def path_collisions(listing: DataFrame, key: str = "path_key", path: str = "path") -> DataFrame:
    """Comparison keys claimed by more than one row; no list is collected, so a key may be
    claimed by any number of rows. ``collision_members`` gives the rows."""
    return (
        listing.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(path).alias("first_path"),
            F.max(path).alias("last_path"),
        )
        .where(F.col("n") > 1)
    )


def collision_members(listing: DataFrame, key: str = "path_key", path: str = "path") -> DataFrame:
    return listing.join(path_collisions(listing, key, path).select(key), key, "left_semi")


def snapshot_diff(heads: DataFrame, listing: DataFrame, me: str, now_ms: int, key: str) -> DataFrame:
    """Change set that turns ``heads`` into ``listing``.

    ``heads``: ``path_id, kind, file_id, vv`` and the compared columns ``display, size,
    mtime_ms, chunks_digest``; ``listing``: ``path_id`` and the compared columns. Both have
    one row per path. Heads that stay tombstones give no row. Identifiers are derived, so a
    rerun gives the same change set.
    """
    head = heads.select(
        "path_id", "kind", "file_id", "vv", *[F.col(c).alias(f"was_{c}") for c in COMPARED]
    )
    both = head.join(
        listing.select("path_id", F.lit(True).alias("_listed"), *COMPARED), "path_id", "full_outer"
    )
    listed, known = F.col("_listed").isNotNull(), F.col("kind").isNotNull()
    same = {c: F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in COMPARED}
    unchanged = same["display"] & same["size"] & same["mtime_ms"] & same["chunks_digest"]
    content_same = same["size"] & same["chunks_digest"]

    change = (
        F.when(~known, F.lit("NEW"))
        .when(listed & (F.col("kind") == "TOMBSTONE"), F.lit("RESTORED"))
        .when(listed & unchanged, F.lit("UNCHANGED"))
        .when(listed, F.lit("MODIFIED"))
        .when(F.col("kind") == "FILE", F.lit("DELETED"))
    )
    reason = F.when(
        F.col("change") == "MODIFIED",
        F.when(~content_same, F.lit("CONTENT"))
        .when(~same["display"], F.lit("CASE_RENAME"))
        .otherwise(F.lit("TOUCH")),
    )
    mine = F.lit(me)
    writes = F.col("change") != "UNCHANGED"
    first = F.array(vv_entry(mine, F.lit(1)))
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .withColumn("reason", reason)
        .withColumn(
            "file_id",
            F.coalesce(
                "file_id",
                ids.uuid_from_digest(
                    ids.joined_id(ids.NEW_FILE, key, mine, F.col("path_id"), F.lit(now_ms))
                ),
            ),
        )
        .withColumn(
            "vv",
            F.when(F.col("change") == "NEW", first)
            .when(writes, vv_increment(F.col("vv"), mine))
            .otherwise(F.col("vv")),
        )
        .withColumn(
            "revision_id",
            F.when(
                writes,
                ids.uuid_from_digest(
                    ids.joined_id(ids.NEW_REVISION, key, mine, F.col("path_id"), F.lit(now_ms))
                ),
            ),
        )
        .select(
            "path_id",
            "change",
            "reason",
            F.when(F.col("change") == "DELETED", F.lit("TOMBSTONE")).otherwise(F.lit("FILE")).alias("kind"),
            "file_id",
            "revision_id",
            F.coalesce("display", "was_display").alias("display"),
            "size",
            F.when(F.col("change") == "DELETED", F.lit(now_ms)).otherwise(F.col("mtime_ms")).alias("mtime_ms"),
            "chunks_digest",
            "vv",
        )
    )


def diff_gate(
    members: DataFrame,
    me: str,
    pending: DataFrame,
    listing: DataFrame,
    error: str = "path_error",
    key: str = "path_key",
    path: str = "path",
) -> DataFrame:
    """Reasons not to trust a diff, one row each with a count; empty when it is safe."""
    mine = members.where(F.col("device") == me).agg(
        F.count(F.lit(1)).alias("known"), F.count_if(F.col("status") == "ACTIVE").alias("active")
    )
    author = mine.select(
        F.when(F.col("known") == 0, F.lit("UNKNOWN_MEMBER"))
        .when(F.col("active") == 0, F.lit("REVOKED"))
        .alias("violation"),
        F.lit(1).cast("bigint").alias("n"),
    ).where(F.col("violation").isNotNull())

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return (
            frame.agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 0)
            .select(F.lit(name).alias("violation"), "n")
        )

    return union_all(
        author,
        counted(pending, "PENDING_MATERIALIZATION"),
        counted(listing.where(F.col(error).isNotNull()), "INVALID_PATH"),
        counted(path_collisions(listing, key, path), "PATH_COLLISION"),
    )


def gated(diff: DataFrame, violations: DataFrame) -> DataFrame:
    """The diff when there is no violation, otherwise no row at all."""
    return diff.where(violations.agg(F.count(F.lit(1))).scalar() == 0)


def scan_report(diff: DataFrame, chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """One row of totals for a scan.

    ``chunks``: every chunk occurrence read by the scan. The first occurrence of an id that
    is not in ``objects`` is stored, the others are reused.
    """

    def how_many(*changes: str) -> Column:
        return F.count_if(F.col("change").isin(*changes))

    files = diff.agg(
        how_many("NEW", "MODIFIED", "RESTORED", "UNCHANGED").alias("files_discovered"),
        how_many("NEW", "MODIFIED", "RESTORED").alias("file_changes"),
        how_many("UNCHANGED").alias("files_unchanged"),
        how_many("DELETED").alias("tombstones_created"),
    )
    per_id = chunks.groupBy("content_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )
    have = objects.where("available").select("content_id").distinct().withColumn("_have", F.lit(1))
    new = F.when(F.col("_have").isNull(), 1).otherwise(0)
    bytes_read = per_id.join(have, "content_id", "left").agg(
        F.coalesce(F.sum(new), F.lit(0)).alias("chunks_stored"),
        F.coalesce(F.sum(F.col("n") - new), F.lit(0)).alias("chunks_reused"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("plaintext_bytes"),
    )
    one = F.lit(1).alias("_one")
    return (
        files.select("*", one)
        .join(bytes_read.select("*", one), "_one")
        .drop("_one")
        .withColumn("changes_committed", F.col("file_changes") + F.col("tombstones_created"))
    )
