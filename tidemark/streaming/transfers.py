"""Resumable-transfer accounting on an unbounded stream of transfer events.

Each micro-batch is replayed by the rules of ``operators.transfers`` on top of what earlier ones
left. What they left is a keyed table with one version per batch: the open transfers of all peers, and
the objects stored that the catalog does not have yet. Closed and cancelled transfers leave nothing, so the state is as large as
what is in flight, and a transfer of any size is replayed as in a batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.transfers import FIELDS, KEYS, replay_transfers
from tidemark.session import discard, materialized
from tidemark.sources.keyed import BUCKETS, KeyedTable

EVENT = (
    "peer string, content_id string, event_id bigint, op string, request_id string, size bigint, "
    "start_offset bigint, len bigint"
)
STATE = "peer string, content_id string, size bigint, received bigint, stored boolean"


def read_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """(peer, content_id, event_id, op, status, received) of all events so far."""
    return spark.read.parquet(f"{base}/outcomes").drop("batch")


def open_state(spark: SparkSession, base: str) -> DataFrame:
    """Open transfers, and stored objects (``peer`` NULL) that were not in the catalog."""
    return KeyedTable(spark, f"{base}/state").read()


def start_transfers(
    spark: SparkSession,
    source: str,
    base: str,
    requests: Callable[[], DataFrame],
    objects: Callable[[], DataFrame],
    checkpoint: str,
    files_per_trigger: int = 100,
    available_now: bool = False,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Follow a folder of event files; statuses go to ``base``/outcomes.

    ``requests`` (``peer, content_id``) and ``objects`` (``content_id, available``) are read in every
    batch. Events of one object come in the order of ``event_id``, batch by batch. A batch that
    is run again starts from the same version of the state and replaces its own outcomes.
    """
    state = KeyedTable(spark, f"{base}/state")
    if not state.version():
        state = KeyedTable.create(spark.createDataFrame([], STATE), f"{base}/state", ["content_id"], buckets)

    def replay(events: DataFrame, number: int) -> None:
        events = materialized(events.select(*KEYS, "event_id", *FIELDS))
        # Version 1 is the empty table before batch 0.
        before = state.manifest(number + 1)
        touched = events.select("content_id").distinct()
        known = state.read(before, state.touched(events, before)).join(touched, "content_id", "left_semi")
        known = materialized(known)
        catalog = materialized(objects().join(touched, "content_id", "left_semi").select("content_id", "available"))
        stored = known.where("stored").select("content_id", F.lit(True).alias("available"))
        opened = known.where("NOT stored").select(*KEYS, "size", "received")
        # Outcomes and states are both needed, and what peers share needs the states twice.
        fold = replay_transfers(events, requests(), catalog.unionByName(stored), opened, once=True)
        fold.outcomes.write.mode("overwrite").parquet(f"{base}/outcomes/batch={number}")
        if state.version() == before.version:
            states = materialized(fold.states)
            done = states.where("state.present").select("content_id").unionByName(stored.select("content_id")).distinct()
            still = states.where("state.open").select(*KEYS, "state.size", "state.received")
            others = opened.join(events.select(*KEYS).distinct(), KEYS, "left_anti")
            flight = still.unionByName(others).join(done, "content_id", "left_anti")
            listed = catalog.where("available").select("content_id")
            kept = done.join(listed, "content_id", "left_anti").select(
                F.lit(None).cast("string").alias("peer"), "content_id",
                F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("received"), F.lit(True).alias("stored"),
            )
            after = materialized(flight.withColumn("stored", F.lit(False)).unionByName(kept))
            state.change(touched, lambda old, new: old.join(new, "content_id", "left_anti").select(*old.columns).unionByName(after.select(*old.columns)))
            discard(states, after)
        discard(events, known, catalog, *fold.written)

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    writer = stream.writeStream.foreachBatch(replay).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
