"""Incremental pull of one peer's change log into the local one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.admission import admit_batch, page_verdicts
from tidemark.operators.changelog import paginate, read_changes
from tidemark.session import materialized

# Records per page and seconds between polls.
PAGE_RECORDS = 64
POLL_SECONDS = 15
# Change files of one micro-batch.
BATCH_FILES = 16

# What is wrong with such a record is wrong with it for ever.
HOPELESS = ("INVALID", "MISMATCH", "REVISION_MISMATCH", "REVISION_CONTENT_MISMATCH", "OBJECT_KIND_MISMATCH")

CHANGE = (
    "group_id string, sequence bigint, revision_id string, manifest_revision_id string, "
    "content_id string, author string, tag string"
)
LOG = "group_id string, revision_id string, content_id string, author string, tag string, sequence bigint, peer_sequence bigint"


@dataclass
class Tables:
    """Local tables an admission reads; callables, as they change between batches."""

    refs: Callable[[], DataFrame]
    objects: Callable[[], DataFrame]
    members: Callable[[], DataFrame]
    provenance: Callable[[], DataFrame]


def pull_pages(
    remote: DataFrame, log: DataFrame, tables: Tables, group: str, peer: str, after: int, n: int = PAGE_RECORDS
) -> tuple[DataFrame, DataFrame]:
    """Admit everything a peer has past a cursor: record statuses and page verdicts.

    All pages are admitted in one job; replays are harmless. The statuses are written once, as
    the log, the requests and the cursor are all derived from them. ``next_cursor`` says how
    far the cursor may move.
    """
    fresh = read_changes(remote, group, after)
    top = remote.where(F.col("group_id") == group).agg(F.coalesce(F.max("sequence"), F.lit(0))).scalar()
    paged = paginate(fresh, n).withColumn("page_id", F.col("page"))
    batch = paged.select(
        "page_id",
        "group_id",
        "revision_id",
        "manifest_revision_id",
        "content_id",
        "author",
        "tag",
        F.col("sequence").alias("arrival"),
        F.col("sequence").alias("peer_sequence"),
    )
    pages = paged.groupBy("page_id", "group_id").agg(F.max("sequence").alias("_last")).select(
        "page_id",
        "group_id",
        F.lit(peer).alias("peer"),
        top.alias("high_watermark"),
        (F.col("_last") < top).alias("has_more"),
    )
    pages = materialized(pages)
    admitted = materialized(
        admit_batch(batch, pages, tables.refs(), log, tables.objects(), tables.members(), tables.provenance())
    )
    return admitted, page_verdicts(admitted, pages)


def next_cursor(verdicts: DataFrame, after: int) -> DataFrame:
    """One row: the cursor after the last page before the first incomplete one.

    ``stalled`` means there are pages but none could be accepted.
    """
    stops = verdicts.where(F.col("accepted_through").isNull()).agg(F.min("page_id")).scalar()
    return verdicts.where(stops.isNull() | (F.col("page_id") < stops)).agg(
        F.coalesce(F.max("accepted_through"), F.lit(after)).alias("sequence")
    ).withColumn("stalled", (F.col("sequence") <= after) & stops.isNotNull())


def _read(spark: SparkSession, base: str, schema: str, batch: int, only: bool = False) -> DataFrame:
    """Rows written by the batches before this one (``only``: by the last of them)."""
    rows = spark.read.schema(schema + ", batch bigint").parquet(base)
    return rows.where(F.col("batch") == batch - 1 if only else F.col("batch") < batch).drop("batch")


def start_pull(
    spark: SparkSession,
    source: str,
    base: str,
    group: str,
    peer: str,
    tables: Tables,
    checkpoint: str,
    files_per_trigger: int = BATCH_FILES,
    available_now: bool = False,
) -> StreamingQuery:
    """Stream a peer's change files into ``base/log``.

    Each micro-batch writes its own folder and reads only those of earlier batches, so a batch
    that runs again after a failure gives the same table. Records that can still be accepted are
    kept in ``base/waiting`` with their status and tried again with the next batch: the stream has
    passed their file, and a missing chunk, author or peer may be added later. Those that nothing
    can mend (``HOPELESS``) are written once, to ``base/rejected``. Duplicates are found by
    revision, not by time.
    """
    for name, schema in (("log", LOG), ("waiting", CHANGE)):
        empty = spark.createDataFrame([], schema)
        empty.write.mode("overwrite").parquet(f"{base}/{name}/batch=-2")

    def admit(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        waiting = _read(session, f"{base}/waiting", CHANGE, batch, only=True)
        columns = [c.split()[0] for c in CHANGE.split(", ")]
        offered = rows.select(*columns).unionByName(waiting).where(F.col("group_id") == group)
        log = _read(session, f"{base}/log", LOG, batch)
        numbered = offered.select(
            F.lit(batch).cast("bigint").alias("page_id"),
            "*",
            F.col("sequence").alias("arrival"),
            F.col("sequence").alias("peer_sequence"),
        ).drop("sequence")
        pages = offered.agg(F.max("sequence").alias("high_watermark")).select(
            F.lit(batch).cast("bigint").alias("page_id"),
            F.lit(group).alias("group_id"),
            F.lit(peer).alias("peer"),
            "high_watermark",
            F.lit(False).alias("has_more"),
        )
        admitted = admit_batch(
            numbered, pages, tables.refs(), log, tables.objects(), tables.members(), tables.provenance()
        )
        admitted.write.mode("overwrite").parquet(f"{base}/admitted/batch={batch}")
        admitted = session.read.parquet(f"{base}/admitted/batch={batch}")
        names = [c.split()[0] for c in LOG.split(", ")]
        admitted.where("status = 'COMMITTED'").select(*names).write.mode("overwrite").parquet(
            f"{base}/log/batch={batch}"
        )
        held = admitted.where("status NOT IN ('COMMITTED', 'REPLAYED')").drop("sequence")
        held = held.withColumnRenamed("peer_sequence", "sequence").select(*columns, "status")
        hopeless = F.col("status").isin(*HOPELESS)
        held.where(~hopeless).write.mode("overwrite").parquet(f"{base}/waiting/batch={batch}")
        held.where(hopeless).write.mode("overwrite").parquet(f"{base}/rejected/batch={batch}")

    stream = (
        spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    )
    writer = stream.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{POLL_SECONDS} seconds").start()
