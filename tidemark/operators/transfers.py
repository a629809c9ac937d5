"""Accounting of resumable transfers, as a replay of their events.

Events of one ``(peer, content_id)``, in ``event_id`` order (unique among the peers of an object): ``BEGIN`` (``request_id``,
``size``), ``APPEND`` (``start_offset``, ``len``), ``COMPLETE`` and ``CANCEL``. Only received
sizes are tracked, never bytes.

A transfer of any number of events is replayed without stepping through it. ``CANCEL`` cuts it into
sessions, the first valid ``BEGIN`` of a session fixes its size, and then an ``APPEND`` counts
only on the offset it starts at, so the accepted ones are a chain of pointers (``chain``). That
gives the state at every segment's start, and the segments are folded side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import let, object_key
from tidemark.operators.chain import last_marked, next_match, reachable_forward
from tidemark.operators.fold import Fold, segmented_fold
from tidemark.operators.manifests import NIL_ID
from tidemark.session import materialized

# Fixed value: largest object of an exchange, in bytes.
MAXIMUM_SIZE = 64 * 1024 * 1024
STATE_TYPE = "struct<open:boolean,size:bigint,received:bigint,present:boolean,requested:boolean,stored_at:bigint>"
KEYS = ["peer", "content_id"]
FIELDS = ["op", "request_id", "size", "start_offset", "len"]


def transfer_status(state: Column, e: Column) -> Column:
    """Status of one event met in ``state``."""
    is_open = F.coalesce(state["open"], F.lit(False))
    present = F.coalesce(state["present"], F.lit(False))
    requested = F.coalesce(state["requested"], F.lit(False))
    begin = (
        F.when(e["request_id"].isNull() | (e["request_id"] == NIL_ID), "NIL_REQUEST")
        .when(e["size"].isNull() | (e["size"] < 1) | (e["size"] > MAXIMUM_SIZE), "SIZE_OUT_OF_RANGE")
        .when(present, "ALREADY_PRESENT")
        .when(~requested, "NOT_REQUESTED")
        .when(is_open & (state["size"] != e["size"]), "SIZE_MISMATCH")
        .when(is_open, "RESUME")
        .otherwise("START")
    )
    append = (
        F.when(~is_open, "NOT_FOUND")
        .when(e["start_offset"] != state["received"], "OFFSET_MISMATCH")
        .when(e["len"] == 0, "NOOP")
        .when(state["received"] + e["len"] > state["size"], "EXCEEDS_SIZE")
        .otherwise("ACCEPTED")
    )
    complete = (
        F.when(~is_open, "NOT_FOUND")
        .when(state["received"] != state["size"], "INCOMPLETE")
        .otherwise("STORED")
    )
    return (
        F.when(e["op"] == "BEGIN", begin)
        .when(e["op"] == "APPEND", append)
        .when(e["op"] == "COMPLETE", complete)
        .when(e["op"] == "CANCEL", F.when(is_open, "CANCELLED").otherwise("NOTHING_TO_CANCEL"))
        .otherwise("UNKNOWN_OPERATION")
    )


def _stored(at: Column | None = None) -> Column:
    """The state of every peer's transfer of an object that is there."""
    nothing = F.lit(None).cast("bigint")
    return F.struct(
        F.lit(False).alias("open"),
        nothing.alias("size"),
        nothing.alias("received"),
        F.lit(True).alias("present"),
        F.lit(False).alias("requested"),
        (nothing if at is None else at).alias("stored_at"),
    )


def _valid_begin() -> Column:
    size = F.col("size")
    return F.col("request_id").isNotNull() & (F.col("request_id") != NIL_ID) & size.between(1, MAXIMUM_SIZE)


def _transition(state: Column, e: Column) -> Column:
    def after(status: Column) -> Column:
        closed = status.isin("STORED", "CANCELLED")
        is_open = F.coalesce(state["open"], F.lit(False))
        received = (
            F.when(status == "START", F.lit(0).cast("bigint"))
            .when(status == "ACCEPTED", state["received"] + e["len"])
            .when(~closed, state["received"])
        )
        stored_at = F.when(status == "STORED", e["_order"]).otherwise(state["stored_at"])
        moved = F.struct(
            ((is_open | (status == "START")) & ~closed).alias("open"),
            F.when(status == "START", e["size"]).when(~closed, state["size"]).alias("size"),
            received.alias("received"),
            (F.coalesce(state["present"], F.lit(False)) | (status == "STORED")).alias("present"),
            (F.coalesce(state["requested"], F.lit(False)) & (status != "STORED")).alias("requested"),
            stored_at.cast("bigint").alias("stored_at"),
        )
        seen = F.struct(
            e["op"].alias("op"),
            status.alias("status"),
            received.alias("received"),
            transfer_status(_stored(), e).alias("late_status"),
        )
        return F.struct(moved.alias("state"), seen.alias("outcome"))

    return let(transfer_status(state, e), after)


def replay_transfers(
    events: DataFrame,
    requests: DataFrame,
    objects: DataFrame,
    open_transfers: DataFrame | None = None,
    segment_rows: int | None = None,
    once: bool = False,
) -> Fold:
    """Status of every event and the final state of every transfer.

    ``requests``: ``peer, content_id`` asked for. ``objects``: ``content_id, available``.
    ``open_transfers``: ``peer, content_id, size, received`` left by an earlier run. With a
    ``group_id`` in all tables, an object and its transfers are those of one group. ``once``: see ``segmented_fold``.
    """
    thing = object_key(events, requests, objects)
    keys = [*thing[:-1], *KEYS]
    pairs = events.select(*keys).distinct()
    asked = requests.select(*keys).distinct().withColumn("requested", F.lit(True))
    have = objects.where("available").select(*thing).distinct().withColumn("present", F.lit(True))
    init = pairs.join(asked, keys, "left").join(have, thing, "left")
    if open_transfers is None:
        init = init.withColumn("_size", F.lit(None).cast("bigint")).withColumn(
            "_received", F.lit(None).cast("bigint")
        )
    else:
        init = init.join(
            open_transfers.select(*keys, F.col("size").alias("_size"), F.col("received").alias("_received")),
            keys,
            "left",
        )
    state = F.struct(
        F.col("_size").isNotNull().alias("open"),
        F.col("_size").alias("size"),
        F.col("_received").alias("received"),
        F.coalesce("present", F.lit(False)).alias("present"),
        F.coalesce("requested", F.lit(False)).alias("requested"),
        F.lit(None).cast("bigint").alias("stored_at"),
    )

    init = init.select(*keys, state.alias("state"))
    # The fold and its states both read it, and requests may be dear to find.
    init = materialized(init) if once else init
    fold = segmented_fold(
        events,
        keys,
        "event_id",
        FIELDS,
        init,
        STATE_TYPE,
        "struct<op:string,status:string,received:bigint,late_status:string>",
        _transition,
        segment_rows,
        lambda rows, first: segment_starts(rows, first, keys)[0],
        once=once,
    )
    fold.written += (init,) if once else ()
    return _across_peers(fold, events, keys)


def segment_starts(rows: DataFrame, init: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, int]:
    """(keys, ``_segment``, ``state``) at the start of every segment, and the rounds it took.

    The rounds are about log2 of the longest run of accepted appends of one session.
    """
    at = [*keys, "_session"]
    rows = last_marked(rows, keys, "event_id", F.col("op") == "CANCEL", F.col("event_id"), "_session")
    rows = materialized(rows.withColumn("_session", F.coalesce("_session", F.lit(-1))))
    # What is open in a session, and from which event on.
    begun = rows.where((F.col("op") == "BEGIN") & _valid_begin()).groupBy(*at).agg(
        F.min("event_id").alias("_from"), F.min_by("size", "event_id").alias("_size")
    )
    may_start = init.where(F.col("state.requested") & ~F.col("state.present")).select(*keys)
    carried = init.where("state.open").select(
        *keys, F.lit(-1).cast("bigint").alias("_session"), F.lit(-1).cast("bigint").alias("_from"),
        F.col("state.size").alias("_size"), F.col("state.received").alias("_value"),
    )
    opened = materialized(
        begun.join(may_start, keys, "left_semi")
        .join(carried.select(*at), at, "left_anti")
        .withColumn("_value", F.lit(0).cast("bigint"))
        .unionByName(carried)
    )
    able = materialized(
        rows.where((F.col("op") == "APPEND") & (F.col("len") > 0))
        .join(opened.drop("_value"), at)
        .where((F.col("event_id") > F.col("_from")) & (F.col("start_offset") + F.col("len") <= F.col("_size")))
        .select(*at, "event_id", "_segment", "_size", "start_offset", (F.col("start_offset") + F.col("len")).alias("_value"))
    )
    starts = opened.select(*at, F.col("_from").alias("event_id"), "_value")
    nodes = able.select(*at, "event_id", "_value").unionByName(starts)
    wanted = able.select(*at, "event_id", F.col("start_offset").alias("_value"))
    pointers = next_match(nodes, wanted, [*at, "_value"], "event_id", "to")
    reached, rounds = reachable_forward(
        pointers.select(*at, F.col("event_id").alias("at"), "to"), starts.select(*at, F.col("event_id").alias("at")), at
    )
    accepted = able.join(reached.withColumnRenamed("at", "event_id"), [*at, "event_id"])

    # The first COMPLETE behind the event that fills a transfer stores it.
    full = (
        accepted.select(*at, "event_id", "_size", "_value")
        .unionByName(opened.select(*at, F.col("_from").alias("event_id"), "_size", "_value"))
        .where(F.col("_value") == F.col("_size"))
        .select(*at, F.col("event_id").alias("_full"))
    )
    stored = (
        rows.where("op = 'COMPLETE'").join(full, at).where(F.col("event_id") > F.col("_full"))
        .groupBy(*keys).agg(F.min("event_id").alias("_stored_at"))
    )

    # The state behind each segment: windows span the segments of a key.
    before = Window.partitionBy(*keys).orderBy("_segment")
    ends = rows.groupBy(*keys, "_segment").agg(
        F.max("event_id").alias("_end"), F.max(F.when(F.col("op") == "CANCEL", F.col("event_id"))).alias("_cancel")
    )
    ends = ends.select(
        *keys, "_segment", "_end", F.coalesce(F.max("_cancel").over(before), F.lit(-1)).alias("_session")
    )
    marks = accepted.groupBy(*at, "_segment").agg(F.max("_value").alias("_value"))
    both = ends.withColumn("_value", F.lit(None).cast("bigint")).unionByName(
        marks.withColumn("_end", F.lit(None).cast("bigint"))
    )
    so_far = F.max("_value").over(Window.partitionBy(*at).orderBy("_segment"))
    held = both.withColumn("_received", so_far).where(F.col("_end").isNotNull()).drop("_value")
    held = held.join(opened, at, "left").join(stored, keys, "left").join(init, keys)
    is_open = F.coalesce(F.col("_from") <= F.col("_end"), F.lit(False))
    state = F.when(F.col("_stored_at") <= F.col("_end"), _stored(F.col("_stored_at")).cast(STATE_TYPE)).otherwise(
        F.struct(
            is_open.alias("open"),
            F.when(is_open, F.col("_size")).alias("size"),
            F.when(is_open, F.coalesce("_received", "_value")).alias("received"),
            F.col("state.present").alias("present"),
            F.col("state.requested").alias("requested"),
            F.lit(None).cast("bigint").alias("stored_at"),
        ).cast(STATE_TYPE)
    )
    later = held.select(*keys, (F.col("_segment") + 1).alias("_segment"), state.alias("state"))
    return init.select(*keys, F.lit(0).cast("bigint").alias("_segment"), "state").unionByName(later), rounds


def _across_peers(fold: Fold, events: DataFrame, keys: list[str]) -> Fold:
    """An object that one peer has stored is there for all peers from then on.

    Up to the first ``STORED`` of an object its peers do not affect each other. Behind it no
    transfer of the object is open and none can start, so an event's status follows from the
    event alone, and the state of every peer is the same. Objects of one peer are left as they are.
    """
    thing = [c for c in keys if c != "peer"]
    shared = events.groupBy(*thing).agg((F.min("peer") != F.max("peer")).alias("_shared")).where("_shared")

    def stored() -> DataFrame:
        done = fold.states.where(F.col("state.stored_at").isNotNull()).groupBy(*thing).agg(
            F.min("state.stored_at").alias("_at")
        )
        return done.join(shared.select(*thing), thing, "left_semi")

    def outcomes() -> DataFrame:
        late = F.coalesce(F.col("event_id") > F.col("_at"), F.lit(False))
        return fold.outcomes.join(stored(), thing, "left").select(
            *keys,
            "event_id",
            "op",
            F.when(late, F.col("late_status")).otherwise(F.col("status")).alias("status"),
            F.when(~late, F.col("received")).alias("received"),
        )

    def states() -> DataFrame:
        there = _stored(F.col("_at")).cast(STATE_TYPE)
        return fold.states.join(stored(), thing, "left").select(
            *keys, F.when(F.col("_at").isNull(), F.col("state")).otherwise(there).alias("state")
        )

    return Fold(outcomes, states, fold.written)


def transfer_progress(states: DataFrame) -> DataFrame:
    """Progress per transfer: ``COMPLETE``, ``OPEN`` or ``IDLE``."""
    return states.select(
        *[c for c in states.columns if c != "state"],
        F.col("state.size").alias("size"),
        F.col("state.received").alias("received"),
        F.when(F.col("state.present"), "COMPLETE").when(F.col("state.open"), "OPEN").otherwise("IDLE").alias("progress"),
    )
