"""Membership registry: additions and revocations.

Member rows: ``group_id, device, tag_key, role, status, added_at_ms, revoked_at_ms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["group_id", "device"]
ACTIVE, REVOKED = "ACTIVE", "REVOKED"


def member_additions(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Status of each addition. ``requests``: ``group_id, device, tag_key, role, position``.

    The first request for an unknown device adds it; later ones are held against that row.
    """
    stored = members.select(*KEY, F.struct("tag_key", "role", "status").alias("_stored"))
    first = requests.groupBy(*KEY).agg(
        F.min(F.struct("position", "tag_key", "role")).alias("_first")
    )
    rows = requests.join(stored, KEY, "left").join(first, KEY)
    known = F.col("_stored").isNotNull()
    key = F.when(known, F.col("_stored.tag_key")).otherwise(F.col("_first.tag_key"))
    role = F.when(known, F.col("_stored.role")).otherwise(F.col("_first.role"))
    return rows.withColumn(
        "status",
        F.when(~known & (F.col("position") == F.col("_first.position")), "ADDED")
        .when(F.col("tag_key") != key, "KEY_MISMATCH")
        .when(F.col("role") != role, "ROLE_MISMATCH")
        .when(known & (F.col("_stored.status") == REVOKED), "REVOKED")
        .otherwise("ALREADY_ACTIVE"),
    ).drop("_stored", "_first")


def add_members(members: DataFrame, additions: DataFrame, now_ms: int) -> DataFrame:
    """Registry after the ``ADDED`` rows of ``member_additions``."""
    new = additions.where(F.col("status") == "ADDED").select(
        *KEY,
        "tag_key",
        "role",
        F.lit(ACTIVE).alias("status"),
        F.lit(now_ms).cast("bigint").alias("added_at_ms"),
        F.lit(None).cast("bigint").alias("revoked_at_ms"),
    )
    return members.select(new.columns).unionByName(new)


def revoke_members(members: DataFrame, devices: DataFrame, now_ms: int) -> DataFrame:
    """Registry after revocations; rows revoked before keep their time.

    ``changed`` tells whether this call revoked the row.
    """
    named = devices.select(*KEY).distinct().withColumn("_named", F.lit(True))
    hit = F.col("_named").isNotNull() & (F.col("status") == ACTIVE)
    return (
        members.join(named, KEY, "left")
        .withColumn("changed", hit)
        .withColumn("status", F.when(F.col("changed"), F.lit(REVOKED)).otherwise(F.col("status")))
        .withColumn(
            "revoked_at_ms", F.when(F.col("changed"), F.lit(now_ms)).otherwise(F.col("revoked_at_ms"))
        )
        .drop("_named")
    )


def member_errors(members: DataFrame) -> DataFrame:
    """Rows that break the rule: active exactly when there is no revocation time."""
    return members.where((F.col("status") == ACTIVE) != F.col("revoked_at_ms").isNull())
