"""Totals per peer and per group for monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.admission import watermark_of


def pull_report(events: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Totals per peer. ``events``: ``peer, kind, bytes``; kinds as counted below.

    With ``progress`` (``peer, sequence``, of one group) also ``peer_high_watermark``, 0 for a peer without one.
    """

    def count(kind: str, name: str):
        return F.count_if(F.col("kind") == kind).alias(name)

    totals = events.groupBy("peer").agg(
        count("PAGE", "pages_received"),
        count("COMMITTED", "records_committed"),
        count("REPLAYED", "records_replayed"),
        count("REQUESTED", "objects_requested"),
        count("STORED", "objects_stored"),
        count("REUSED", "objects_reused"),
        F.coalesce(F.sum(F.when(F.col("kind") == "STORED", F.col("bytes"))), F.lit(0)).alias("bytes_received"),
        count("FAILED", "failures"),
    )
    if progress is None:
        return totals
    reached = progress.groupBy("peer").agg(F.max("sequence").alias("peer_high_watermark"))
    return totals.join(reached, "peer", "left").na.fill(0, ["peer_high_watermark"])


def serve_report(events: DataFrame) -> DataFrame:
    """Totals per peer of what was sent to it."""
    sent = F.when(F.col("kind") == "OBJECT_SENT", F.col("bytes"))
    return events.groupBy("peer").agg(
        F.count_if(F.col("kind") == "PAGE_SENT").alias("pages_sent"),
        F.count_if(F.col("kind") == "OBJECT_SENT").alias("objects_sent"),
        F.coalesce(F.sum(sent), F.lit(0)).alias("bytes_sent"),
        F.count_if(F.col("kind") == "ACKNOWLEDGED").alias("acknowledgements_received"),
    )


def sync_report(pulls: DataFrame, replay: DataFrame | None = None) -> DataFrame:
    """One row over all peers of a round, from ``pull_report``; with the totals of ``replay_report`` beside it."""
    totals = pulls.agg(
        F.count_if(F.col("failures") == 0).alias("peers_synchronized"),
        F.count_if(F.col("failures") > 0).alias("peers_failed"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("pages_received", "records_committed", "objects_stored", "bytes_received")
        ],
    )
    if replay is None:
        return totals
    one = F.lit(1).alias("_one")
    return totals.select("*", one).join(replay.select("*", one), "_one").drop("_one")


def replication_status(log: DataFrame, peers: DataFrame, progress: DataFrame, requests: DataFrame) -> DataFrame:
    """Cursor, lag and queue length of every peer of every group."""
    tops = log.groupBy("group_id").agg(F.max("sequence").alias("local_change_count"))
    queued = requests.groupBy("group_id", "peer").agg(F.count(F.lit(1)).alias("pending_objects"))
    return (
        watermark_of(progress, peers.select("group_id", "peer"))
        .withColumnRenamed("sequence", "high_watermark")
        .join(tops, "group_id", "left")
        .join(queued, ["group_id", "peer"], "left")
        .na.fill(0, ["local_change_count", "pending_objects"])
        .withColumn("lag", F.greatest(F.col("local_change_count") - F.col("high_watermark"), F.lit(0)))
    )


def status_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("peers"),
        F.coalesce(F.max("local_change_count"), F.lit(0)).alias("local_change_count"),
        F.coalesce(F.sum("pending_objects"), F.lit(0)).alias("pending_objects"),
    )
