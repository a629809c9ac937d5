"""One round of pulling from a peer, from validation to the cursor, and the records that waited.

A round reads past the peer's cursor, refuses the log from the first page that breaks a rule of the
wire, admits the pages before it, and returns every table the round changes: log, cursor, request
queue, stored authentication, waiting records and their wake-up index. When objects arrive, ``retry_waiting``
admits the records that became complete; they were authenticated when they came, so an author
revoked meanwhile does not reject them.

The driver holds three numbers of a round: the cursor, the first refused page and the last sequence before it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import object_key
from tidemark.operators.admission import admit_batch, advance_watermark, judged_errors, page_verdicts, record_error, watermark_of
from tidemark.operators.changelog import paginate, read_changes
from tidemark.operators.manifests import missing_objects
from tidemark.operators.ranking import GROUP_ROWS
from tidemark.operators.requests import clear_requests, enqueue
from tidemark.operators.waiting import RECORD, complete_already, waiting_index, wake
from tidemark.session import materialized

# Statuses of records whose author was not established.
UNAUTHENTICATED = ("UNKNOWN_PEER", "PEER_REVOKED", "REVISION_MISMATCH", "MISMATCH", "UNKNOWN_MEMBER", "REVOKED", "INVALID")
SAID = ["group_id", "revision_id", "content_id", "author", "tag"]
ENVELOPE = ["revision_id", "content_id", "author", "tag", "payload_bytes", "payload_kind", "payload_content_id"]


@dataclass
class Catalog:
    """What a pull looks up and never changes."""

    refs: DataFrame
    objects: DataFrame
    members: DataFrame


@dataclass
class PullState:
    """What a pull changes; ``waiting`` are records (``SAID``, ``peer``, ``peer_sequence``)."""

    log: DataFrame
    progress: DataFrame
    requests: DataFrame
    provenance: DataFrame
    waiting: DataFrame
    index: DataFrame


def page_errors(paged: DataFrame, envelopes: DataFrame, top, n: int) -> DataFrame:
    """``batch_errors`` of pages (``page, sequence``); ``envelopes``: ``sequence`` and ``ENVELOPE`` as they were sent.

    A record without an envelope has NULL fields and breaks the rules of lengths. Envelopes are judged where they lie, so
    that only one word of each is shuffled.
    """
    judged = envelopes.select("sequence", record_error().alias("record_error"), F.lit(True).alias("_sent"))
    sent = paged.select(F.col("page").alias("batch_id"), "sequence").join(judged, "sequence", "left")
    sent = sent.withColumn(
        "record_error", F.when(F.col("_sent").isNull(), "INVALID_IDENTIFIER_LENGTH").otherwise(F.col("record_error"))
    )
    headers = paged.select(F.col("page").alias("batch_id")).distinct().withColumn("high_watermark", top)
    return judged_errors(sent.withColumn("idx", F.col("sequence")), headers, maximum_records=n)


def narrowed(catalog: Catalog, manifests: DataFrame) -> Catalog:
    """The catalog as far as ``manifests`` (``content_id``, and ``group_id`` where objects have groups) go, if these are few.

    One scan finds their references and one the objects these name; all else that is asked of them is small then.
    """
    key = object_key(catalog.objects, manifests, catalog.refs)
    named = materialized(manifests.select(*key[:-1], F.col("content_id").alias("manifest_id")).distinct())
    if named.count() > GROUP_ROWS:
        return catalog
    refs = materialized(catalog.refs.join(named, [*key[:-1], "manifest_id"], "left_semi"))
    objects = materialized(catalog.objects.join(refs.select(*key).distinct(), key, "left_semi"))
    return replace(catalog, refs=refs, objects=objects)


def pull_round(
    remote: DataFrame,
    envelopes: DataFrame,
    catalog: Catalog,
    state: PullState,
    group,
    peer,
    now_ms: int,
    n: int = 64,
) -> tuple[DataFrame, DataFrame, PullState]:
    """Statuses of the records of the pages admitted, verdicts of all pages, and the state after the round.

    ``remote``: the peer's log (``group_id, sequence, revision_id, manifest_revision_id, content_id, author,
    tag``). Verdicts are those of ``page_verdicts`` with ``error``; a refused page and all behind it have no totals and
    are not admitted. The cursor stops before the first page that is refused or not complete; a peer that has
    nothing new leaves the state as it is. A round that is made again changes nothing more.
    """
    spark = remote.sparkSession
    asked = remote.where(F.col("group_id") == group)
    who = spark.range(1).select(
        F.lit(group).cast(remote.schema["group_id"].dataType).alias("group_id"),
        F.lit(peer).cast(state.progress.schema["peer"].dataType).alias("peer"),
    )
    after = watermark_of(state.progress, who).first()["sequence"]
    top = F.lit(asked.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("top")).first()["top"])
    fresh = read_changes(remote, group, after)
    # Pages are judged by sequences and envelopes alone; only records of pages that are not refused are read whole.
    numbered = materialized(paginate(fresh.select("group_id", "sequence"), n))
    errors = materialized(page_errors(numbered, envelopes, top, n)).select(F.col("batch_id").alias("page_id"), "error")
    refused = errors.where(F.col("error").isNotNull()).agg(F.min("page_id").alias("page")).first()["page"]
    if refused is not None:
        last = numbered.where(F.col("page") < refused).agg(F.max("sequence").alias("last")).first()["last"]
        fresh = fresh.where(F.lit(False) if last is None else F.col("sequence") <= last)
    whole = materialized(paginate(fresh, n).withColumnRenamed("page", "page_id"))
    catalog = narrowed(catalog, whole)
    pages = whole.groupBy("page_id", "group_id").agg(F.max("sequence").alias("_last")).select(
        "page_id", "group_id", F.lit(peer).alias("peer"), top.alias("high_watermark"), (F.col("_last") < top).alias("has_more")
    )
    batch = whole.select(
        "page_id", "group_id", "revision_id", "manifest_revision_id", "content_id", "author", "tag",
        F.col("sequence").alias("arrival"), F.col("sequence").alias("peer_sequence"),
    )
    admitted = materialized(
        admit_batch(batch, pages, catalog.refs, state.log, catalog.objects, catalog.members, state.provenance)
    )
    verdicts = page_verdicts(admitted, pages)
    verdicts = errors.join(verdicts, "page_id", "left").select(*verdicts.columns, "error")
    cursor = F.coalesce(F.max("accepted_through"), F.lit(after))
    stops = verdicts.where(F.col("accepted_through").isNull()).agg(F.min("page_id")).scalar()
    reached = verdicts.where(stops.isNull() | (F.col("page_id") < stops)).agg(cursor.alias("sequence"))
    progress = advance_watermark(state.progress, reached.join(who, F.lit(True)).select("group_id", "peer", "sequence"))
    waits = admitted.where("status = 'WAITING'").select(*SAID, F.lit(peer).alias("peer"), "peer_sequence")
    waiting = state.waiting.unionByName(waits.join(state.waiting, [*RECORD, "peer"], "left_anti"))
    lacking = waiting_index(waits.join(state.index, RECORD, "left_anti"), catalog.refs, catalog.objects)
    return admitted, verdicts, replace(
        _after(admitted, state),
        progress=materialized(progress),
        requests=materialized(_queued(waits, catalog, state.requests, now_ms)),
        waiting=materialized(waiting),
        index=materialized(state.index.unionByName(lacking)),
    )


def _after(admitted: DataFrame, state: PullState) -> PullState:
    """Log and stored authentication after a batch; what was stored first stays."""
    committed = admitted.where("status = 'COMMITTED'").select("group_id", "revision_id", "content_id", "sequence")
    said = admitted.where(~F.col("status").isin(*UNAUTHENTICATED)).select(*SAID).distinct()
    known = said.join(state.provenance, RECORD, "left_anti")
    return replace(
        state,
        log=state.log.select(*committed.columns).unionByName(committed),
        provenance=state.provenance.select(*SAID).unionByName(known),
    )


def _queued(waits: DataFrame, catalog: Catalog, requests: DataFrame, now_ms: int) -> DataFrame:
    """Requests with the absent objects of waiting records added, for the peer that sent these."""
    named = waits.select("group_id", "peer", F.col("content_id").alias("manifest_id")).distinct()
    on = [*object_key(catalog.objects, waits, catalog.refs)[:-1], "manifest_id"]
    absent = missing_objects(catalog.refs.join(named, on, "left_semi"), catalog.objects, ["manifest_id"])
    wanted = named.join(absent, on).select("group_id", "peer", "content_id")
    return requests.unionByName(enqueue(requests, wanted, catalog.objects, now_ms))


def retry_waiting(
    catalog: Catalog, state: PullState, arrived: DataFrame, group, peer
) -> tuple[DataFrame, PullState]:
    """Statuses of a peer's waiting records that ``arrived`` objects made complete, and the state after.

    ``arrived``: ``group_id, content_id`` of objects that ``catalog.objects`` now lists as available. Records of other peers that they
    complete keep waiting with nothing missing until that peer's own retry. Only index rows of the arrived objects are
    looked at; records that still lack an object are not admitted.
    """
    key = object_key(catalog.objects, arrived)
    complete, rest = wake(state.index, arrived.select(*key))
    # Records that a retry for another peer completed have left the index already.
    candidates = state.waiting.where((F.col("group_id") == group) & (F.col("peer") == peer))
    catalog = narrowed(catalog, candidates)
    unlisted = candidates.join(state.index, RECORD, "left_anti")
    here = complete.unionByName(complete_already(unlisted, catalog.refs, catalog.objects)).distinct()
    offered = materialized(candidates.join(here, RECORD, "left_semi"))
    batch = offered.select(
        F.lit(1).cast("bigint").alias("page_id"), "group_id", "revision_id", F.col("revision_id").alias("manifest_revision_id"),
        "content_id", "author", "tag", F.col("peer_sequence").alias("arrival"), "peer_sequence",
    )
    pages = batch.groupBy("page_id", "group_id").agg(F.max("peer_sequence").alias("high_watermark")).select(
        "page_id", "group_id", F.lit(peer).alias("peer"), "high_watermark", F.lit(False).alias("has_more")
    )
    admitted = materialized(
        admit_batch(batch, pages, catalog.refs, state.log, catalog.objects, catalog.members, state.provenance)
    )
    done = admitted.where("status <> 'WAITING'").select(*RECORD, F.lit(peer).alias("peer"))
    return admitted, replace(
        _after(admitted, state),
        requests=materialized(clear_requests(state.requests, arrived)),
        waiting=materialized(state.waiting.join(done, [*RECORD, "peer"], "left_anti")),
        index=materialized(rest),
    )


def new_state(spark: SparkSession, log: DataFrame, provenance: DataFrame) -> PullState:
    """The state before the first round, with types of ids as in ``provenance``."""
    kinds = {f.name: f.dataType.simpleString() for f in provenance.schema}
    group, device = kinds["group_id"], kinds["author"]

    def empty(schema: str) -> DataFrame:
        return spark.createDataFrame([], schema)

    return PullState(
        log=log,
        progress=empty(f"group_id {group}, peer {device}, sequence bigint"),
        requests=empty(
            f"group_id {group}, peer {device}, content_id string, requested_at_ms bigint, attempts bigint, last_attempt_ms bigint"
        ),
        provenance=provenance,
        waiting=empty(
            f"group_id {group}, revision_id string, content_id string, author {device}, tag string, peer {device}, peer_sequence bigint"
        ),
        index=empty(f"group_id {group}, revision_id string, object_id string, missing bigint"),
    )
