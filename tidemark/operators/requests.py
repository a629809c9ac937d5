"""Queue of objects asked from peers.

Request rows: ``group_id, peer, content_id, requested_at_ms, attempts, last_attempt_ms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import object_key
from tidemark.operators.manifests import usable
from tidemark.operators.ranking import dense_rank, hex_order, top_per_key
from tidemark.session import materialized

KEY = ["group_id", "peer", "content_id"]
# Fixed value: content ids in one request.
IDS_PER_REQUEST = 4096


def enqueue(requests: DataFrame, wanted: DataFrame, objects: DataFrame, now_ms: int) -> DataFrame:
    """The rows to add: wanted ids that are neither readable nor queued for that peer."""
    return (
        wanted.select(*KEY)
        .distinct()
        .join(usable(objects), object_key(objects, wanted), "left_anti")
        .join(requests.select(*KEY), KEY, "left_anti")
        .select(
            *KEY,
            F.lit(now_ms).cast("bigint").alias("requested_at_ms"),
            F.lit(0).cast("bigint").alias("attempts"),
            F.lit(None).cast("bigint").alias("last_attempt_ms"),
        )
    )


def pending_requests(requests: DataFrame, n: int) -> DataFrame:
    """Oldest ``n`` requests of every peer, by time and then content id."""
    return top_per_key(
        requests, ["group_id", "peer"], ["requested_at_ms", "content_id"], n, salt="content_id"
    )


def mark_attempts(requests: DataFrame, attempted: DataFrame, now_ms: int) -> DataFrame:
    """Requests after one more attempt for the rows named in ``attempted``."""
    hit = attempted.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    tried = F.col("_hit").isNotNull()
    return (
        requests.join(hit, KEY, "left")
        .withColumn("attempts", F.col("attempts") + F.when(tried, 1).otherwise(0))
        .withColumn("last_attempt_ms", F.when(tried, F.lit(now_ms)).otherwise(F.col("last_attempt_ms")))
        .drop("_hit")
    )


def clear_requests(requests: DataFrame, admitted: DataFrame) -> DataFrame:
    """Requests left after objects were admitted, whoever was asked for them."""
    return requests.join(
        admitted.select("group_id", "content_id").distinct(), ["group_id", "content_id"], "left_anti"
    )


def request_batches(missing: DataFrame, by: list[str], n: int = IDS_PER_REQUEST) -> DataFrame:
    """Unique hex ids of each ``by`` group in requests of at most ``n`` ids, in id order.

    The ids are written once: ranking reads them twice, and what they come from often has a catalog to broadcast.
    """
    once = materialized(missing.select(*by, "content_id").distinct())
    once = once.withColumn("_order", hex_order(F.col("content_id")))
    ranked = dense_rank(once, "_order", by=by, out="_rank", ties=["content_id"])
    return (
        ranked.groupBy(*by, F.expr(f"(_rank - 1) div {n} + 1").alias("request"))
        .agg(F.array_sort(F.collect_list("content_id")).alias("content_ids"))
        .withColumn("ids", F.size("content_ids").cast("bigint"))
    )
