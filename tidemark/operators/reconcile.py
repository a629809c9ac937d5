"""Reconciliation of replicated changes with the local heads.

Change rows: ``path_id, file_id, revision_id, kind ('FILE' or 'TOMBSTONE'), vv, content_id``
and, for logs, ``sequence`` and ``author``. ``content_id`` identifies the whole record, so
two records of one revision are equal exactly when it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.common import first_status, let
from tidemark.functions.paths import conflict_path
from tidemark.functions.vv import VV_TYPE, vv_ge, vv_label, vv_relation
from tidemark.operators.chain import committed_rows, last_marked
from tidemark.operators.fold import Fold, segmented_fold
from tidemark.session import materialized
from tidemark.sources.keyed import BUCKETS, KeyedTable

FILE, TOMBSTONE = "FILE", "TOMBSTONE"
#: Rows at the end of a segment that are looked at for states it may end in.
LAST_ROWS = 256
RECORD = ["file_id", "revision_id", "kind", "vv", "content_id"]
RECORD_TYPE = (
    f"struct<file_id:string,revision_id:string,kind:string,vv:{VV_TYPE},content_id:string>"
)
STATE_TYPE = RECORD_TYPE[:-1] + ",absent:boolean>"
OUTCOME_TYPE = (
    "struct<revision_id:string,action:string,canonical_revision:string,conflict_revision:string>"
)


def record(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in RECORD])


def decide(local: Column, incoming: Column) -> Column:
    """Decision for one incoming record against the local one (NULL: no local head)."""
    same_revision = local["revision_id"] == incoming["revision_id"]
    local_file = local["kind"] == FILE
    incoming_file = incoming["kind"] == FILE

    def ordered(relation: Column) -> Column:
        local_wins = vv_ge(
            local["vv"], local["revision_id"], incoming["vv"], incoming["revision_id"]
        )
        winner = F.when(local_wins, local["revision_id"]).otherwise(incoming["revision_id"])
        loser = F.when(local_wins, incoming["revision_id"]).otherwise(local["revision_id"])
        undecided = ~relation.isin("ANCESTOR", "DESCENDANT")
        both = undecided & local_file & incoming_file
        action = (
            F.when(relation == "ANCESTOR", "USE_INCOMING")
            .when(relation == "DESCENDANT", "KEEP_LOCAL")
            .when(both, "KEEP_BOTH")
            .when(local_file, "KEEP_LOCAL")
            .when(incoming_file, "USE_INCOMING")
            .when(local_wins, "KEEP_LOCAL")
            .otherwise("USE_INCOMING")
        )
        return _decision(action, F.when(both, winner), F.when(both, loser))

    return (
        F.when(local.isNull() | local["revision_id"].isNull(), _decision(F.lit("USE_INCOMING")))
        .when(local["file_id"] != incoming["file_id"], _decision(F.lit("ERROR_DIFFERENT_FILES")))
        .when(
            same_revision & local["content_id"].eqNullSafe(incoming["content_id"]),
            _decision(F.lit("NO_CHANGE")),
        )
        .when(same_revision, _decision(F.lit("ERROR_REVISION_COLLISION")))
        .otherwise(let(vv_relation(local["vv"], incoming["vv"]), ordered))
    )


def _decision(action: Column, canonical: Column | None = None, conflict: Column | None = None) -> Column:
    missing = F.lit(None).cast("string")
    return F.struct(
        action.alias("action"),
        (missing if canonical is None else canonical).alias("canonical_revision"),
        (missing if conflict is None else conflict).alias("conflict_revision"),
    )


def reconcile(
    heads: DataFrame,
    incoming: DataFrame,
    on: list[str] | None = None,
    missing: DataFrame | None = None,
) -> DataFrame:
    """Decide every incoming row on its own against the head of its key.

    ``missing`` lists revisions with absent chunks; they turn into ``MISSING_OBJECTS`` where
    the decision would need the content.
    """
    on = on or ["path_id"]
    local = heads.select(*on, record().alias("local"))
    joined = incoming.join(local, on, "left")
    out = joined.withColumn("_d", decide(F.col("local"), record()))
    action = F.col("_d.action")
    if missing is not None:
        absent = missing.select("revision_id").distinct().withColumn("_absent", F.lit(True))
        local_absent = absent.select(
            F.col("revision_id").alias("_local_rev"), F.lit(True).alias("_local_absent")
        )
        out = (
            out.join(absent, "revision_id", "left")
            .withColumn("_local_rev", F.col("local.revision_id"))
            .join(local_absent, "_local_rev", "left")
        )
        blocked = (action.isin("USE_INCOMING", "KEEP_BOTH") & F.col("_absent").isNotNull()) | (
            (action == "KEEP_BOTH") & F.col("_local_absent").isNotNull()
        )
        action = F.when(blocked, F.lit("MISSING_OBJECTS")).otherwise(action)
    decided = out.withColumn("action", action)
    kept = decided["action"] == "KEEP_BOTH"
    return (
        decided.withColumn("canonical_revision", F.when(kept, F.col("_d.canonical_revision")))
        .withColumn("conflict_revision", F.when(kept, F.col("_d.conflict_revision")))
        .drop("_d", "_absent", "_local_rev", "_local_absent")
    )


def fold_heads(
    heads: DataFrame,
    changes: DataFrame,
    me: str,
    folded_through: int = 0,
    segment_rows: int | None = None,
    on: list[str] | None = None,
    missing: DataFrame | None = None,
) -> Fold:
    """Replay the log onto the heads, path by path, in sequence order.

    Rows by ``me`` and rows without an author are not replayed. ``outcomes`` has one row per
    replayed change with its action and the pair of revisions a conflict kept; ``states`` has
    the final record of every path. Pass ``folded_through`` to continue from stored heads.

    ``on`` are the columns of a path, ``["group_id", "path_id"]`` for logs of several groups.
    ``missing`` lists revisions with absent chunks: a change that would need them, as the new
    record or to keep both, is ``MISSING_OBJECTS`` and leaves the head as it is.
    """
    on = on or ["path_id"]
    foreign = changes.where(
        (F.col("sequence") > folded_through) & F.col("author").isNotNull() & (F.col("author") != me)
    )
    local = heads.select(*on, *RECORD)
    if missing is None:
        foreign, local = (frame.withColumn("absent", F.lit(False)) for frame in (foreign, local))
    else:
        gone = missing.select("revision_id").distinct().withColumn("absent", F.lit(True))
        foreign, local = (
            frame.join(gone, "revision_id", "left").na.fill(False, ["absent"]) for frame in (foreign, local)
        )
    fields = [*RECORD, "absent"]

    def mine(row: Column) -> Column:
        return F.struct(*[row[c].alias(c) for c in fields])

    def decided(head: Column, row: Column) -> Column:
        def with_objects(d: Column) -> Column:
            kept = d["action"] == "KEEP_BOTH"
            lacking = F.coalesce(head["absent"], F.lit(False)) & kept | row["absent"] & (
                kept | (d["action"] == "USE_INCOMING")
            )
            return F.struct(
                F.when(lacking, "MISSING_OBJECTS").otherwise(d["action"]).alias("action"),
                F.when(~lacking, d["canonical_revision"]).alias("canonical_revision"),
                F.when(~lacking, d["conflict_revision"]).alias("conflict_revision"),
            )

        found = decide(head, mine(row))
        return found if missing is None else let(found, with_objects)

    def takes(d: Column, row: Column) -> Column:
        return (d["action"] == "USE_INCOMING") | (
            (d["action"] == "KEEP_BOTH") & (d["canonical_revision"] == row["revision_id"])
        )

    def transition(head: Column, row: Column) -> Column:
        def moved(d: Column) -> Column:
            return F.struct(
                F.when(takes(d, row), mine(row)).otherwise(head).alias("state"),
                F.struct(
                    row["revision_id"].alias("revision_id"),
                    d["action"].alias("action"),
                    d["canonical_revision"].alias("canonical_revision"),
                    d["conflict_revision"].alias("conflict_revision"),
                ).alias("outcome"),
            )

        return let(decided(head, row), moved)

    def may_end_in(rows: Column) -> Column:
        """Records among the last rows that no later row takes the place of, the latest first."""

        def of(last: Column) -> Column:
            def stays(row: Column, place: Column) -> Column:
                later = F.slice(last, place + 2, LAST_ROWS)
                return ~F.exists(later, lambda other: let(decided(mine(row), other), lambda d: takes(d, other)))

            return F.transform(F.reverse(F.filter(last, stays)), mine)

        return let(F.slice(rows, F.greatest(F.size(rows) - LAST_ROWS, F.lit(0)) + 1, LAST_ROWS), of)

    def of_other_files(rows: DataFrame, heads: DataFrame) -> DataFrame:
        """Changes of another file than the path's head; a head is never replaced by one of another file.

        The file is that of the stored head, or of the first change that can become one. Where an
        identifier is NULL this is not certain, and all changes of the path are folded.
        """
        named = F.col("file_id").isNotNull() & F.col("revision_id").isNotNull()
        able = F.when(~F.col("absent"), F.col("sequence"))
        first = rows.groupBy(*on).agg(
            F.min_by(F.struct("sequence", *fields), able).alias("_row"), F.min(named).alias("_named")
        )
        held = heads.where("state.revision_id IS NOT NULL").select(*on, F.col("state").alias("_held"))
        # A stored head is there before the first change; the record a path starts with comes after itself.
        known = first.join(held, on, "left").select(
            *on,
            F.coalesce("_held", F.struct(*[F.col(f"_row.{c}").alias(c) for c in fields])).alias("_idle"),
            F.when(F.col("_held").isNull(), F.col("_row.sequence")).alias("_since"),
            (F.col("_named") & (F.col("_held").isNull() | F.col("_held.file_id").isNotNull())).alias("_sure"),
        )
        other = F.col("_sure") & (F.col("_idle.file_id") != F.col("file_id"))
        other = other & (F.col("_since").isNull() | (F.col("sequence") > F.col("_since")))
        told = rows.join(known, on, "left")
        return told.select(*rows.columns, F.when(other, F.col("_idle")).cast(STATE_TYPE).alias("_idle"))

    return segmented_fold(
        foreign,
        on,
        "sequence",
        fields,
        local.select(*on, F.struct(*fields).alias("state")),
        STATE_TYPE,
        OUTCOME_TYPE,
        transition,
        segment_rows,
        entries=may_end_in,
        apart=of_other_files,
    )


def replay_report(outcomes: DataFrame, changes: DataFrame, me: str, folded_through: int = 0) -> DataFrame:
    """Totals of a replay; own rows are examined and counted nowhere else."""
    log = changes.where(F.col("sequence") > folded_through).agg(
        F.count(F.lit(1)).alias("records_examined"),
        F.count_if(F.col("author").isNull()).alias("unsigned_records_skipped"),
        F.count_if(F.col("author") == me).alias("own_records"),
    )
    done = outcomes.agg(
        F.count_if(F.col("action") == "USE_INCOMING").alias("records_applied"),
        F.count_if(F.col("action") == "NO_CHANGE").alias("records_unchanged"),
        F.count_if(F.col("action") == "KEEP_LOCAL").alias("records_kept_local"),
        F.count_if(F.col("action") == "KEEP_BOTH").alias("conflicts_kept_both"),
        F.count_if(F.col("action").startswith("ERROR")).alias("records_failed"),
    )
    one = F.lit(1).alias("_one")
    return log.select("*", one).join(done.select("*", one), "_one").drop("_one")


REPEATED_COUNTER, NO_AUTHOR = "REPEATED_COUNTER", "NO_AUTHOR"


def _frontier_entries(changes: DataFrame) -> DataFrame:
    """One row per device of every record, with the higher counter of a device named twice."""
    once = F.filter(
        F.array_distinct("vv"),
        lambda e: ~F.exists("vv", lambda x: (x["d"] == e["d"]) & (x["c"] > e["c"])),
    )
    return changes.select(
        "file_id", "revision_id", "author", F.xxhash64("vv").alias("_same"), F.explode(once).alias("e")
    ).select("file_id", "revision_id", "author", "_same", F.col("e.d").alias("d"), F.col("e.c").alias("c"))


def frontier(changes: DataFrame) -> DataFrame:
    """Revisions of a file that no other revision descends from; more than one is a conflict.

    A record by author ``a`` survives when only records by ``a`` hold the file's highest
    counter of ``a``. This needs causally consistent logs: a vector that knows a counter of
    ``a`` knows everything that record knew. Aggregates and one join, so a hot file is reduced
    map-side. Two irregular cases are kept and flagged, see ``frontier_problems``: records that
    share their author's counter (a restored backup) all survive, and a record without an author
    survives when it, or records with the same vector, alone hold some highest counter. Of a
    device named twice in a vector the higher counter counts.
    """
    entries = _frontier_entries(changes)
    own = F.coalesce(F.col("author") == F.col("d"), F.lit(False))
    holders = entries.groupBy("file_id", "d", "c").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(own).alias("own"),
        (F.min("_same") == F.max("_same")).alias("same"),
    )
    top = holders.groupBy("file_id", "d").agg(F.max_by(F.struct("c", "n", "own", "same"), "c").alias("top"))
    candidates = entries.where(own | F.col("author").isNull())
    alone = F.when(own, F.col("top.n") == F.col("top.own")).otherwise(F.col("top.same"))
    return (
        candidates.join(top, ["file_id", "d"])
        .where((F.col("c") == F.col("top.c")) & alone)
        .select(
            "file_id",
            "author",
            "revision_id",
            F.when(F.col("author").isNull(), NO_AUTHOR)
            .when(F.col("top.own") > 1, REPEATED_COUNTER)
            .alias("flag"),
        )
        .distinct()
    )


#: State of a maintained frontier: tops (``d`` to ``high``) and, where ``entries`` is set, surviving records.
FRONTIER_STATE = (
    "file_id string, d string, c bigint, n bigint, own bigint, low bigint, high bigint, "
    "author string, revision_id string, entries array<struct<d: string, c: bigint>>"
)
_TOP = ["c", "n", "own", "low", "high"]


def frontier_table(spark: SparkSession, base: str, buckets: int = BUCKETS) -> KeyedTable:
    """An empty state for ``maintain_frontier``, in buckets of the file."""
    empty = spark.createDataFrame([], FRONTIER_STATE)
    return KeyedTable.create(empty, base, ["file_id"], buckets, {"batch": -1})


def maintain_frontier(state: KeyedTable, changes: DataFrame, batch: int) -> int:
    """Move the state on by one batch of changes, unless it has had the batch; its version after that.

    Tops are what ``frontier`` derives for every file and device: the highest counter, how many records
    hold it, how many of these are their author's own, and whether they are alike. Counters only rise
    and holders of a counter are only added, so a record that fell never returns: beside the tops only
    the records that survive so far are kept. A batch reads and rewrites the buckets of its own files.
    Tops, survivors and the batch's number are one version, so a batch given again after a failure
    changes nothing. Batches are numbered upwards; a record in two batches is two records, as in ``frontier``.
    """
    entries = _frontier_entries(changes)
    own = F.coalesce(F.col("author") == F.col("d"), F.lit(False))
    tops = entries.groupBy("file_id", "d", "c").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(own).alias("own"),
        F.min("_same").alias("low"),
        F.max("_same").alias("high"),
    )
    offered = _gathered(entries.where(own | F.col("author").isNull()))
    rows = tops.unionByName(offered, allowMissingColumns=True)

    def moved(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new)
        held = both.where(F.col("entries").isNull()).groupBy("file_id", "d", "c").agg(
            F.sum("n").alias("n"), F.sum("own").alias("own"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        highest = held.groupBy("file_id", "d").agg(F.max_by(F.struct(*_TOP), "c").alias("top"))
        highest = highest.select("file_id", "d", "top.*")
        survivors = _gathered(_alive(both, highest))
        return highest.unionByName(survivors, allowMissingColumns=True)

    return state.change(rows, moved, {"batch": batch}, lambda facts: facts["batch"] >= batch)


def _gathered(entries: DataFrame) -> DataFrame:
    """Records with the entries they may survive by: their author's, or all without an author."""
    return entries.groupBy("file_id", "author", "revision_id").agg(
        F.array_sort(F.collect_set(F.struct("d", "c"))).alias("entries")
    )


def _alive(state: DataFrame, tops: DataFrame) -> DataFrame:
    """Entries of records of a state that hold a top of their file alone."""
    rows = state.where(F.col("entries").isNotNull()).select("file_id", "author", "revision_id", F.explode("entries").alias("e"))
    alone = F.when(F.col("author").isNull(), F.col("low") == F.col("high")).otherwise(F.col("n") == F.col("own"))
    return (
        rows.select("file_id", "author", "revision_id", F.col("e.d").alias("d"), F.col("e.c").alias("c"))
        .join(tops.select("file_id", "d", *_TOP), ["file_id", "d", "c"])
        .where(alone)
    )


def kept_frontier(state: KeyedTable, files: DataFrame | None = None) -> DataFrame:
    """``frontier`` of all changes the state was given; with ``files`` (``file_id``) of these, read from their buckets."""
    now = state.manifest()
    rows = state.read(now, None if files is None else state.touched(files, now))
    if files is not None:
        rows = rows.join(files.select("file_id").distinct(), "file_id", "left_semi")
    flag = F.when(F.col("author").isNull(), NO_AUTHOR).when(F.col("own") > 1, REPEATED_COUNTER)
    alive = _alive(rows, rows.where(F.col("entries").isNull()))
    return alive.select("file_id", "author", "revision_id", flag.alias("flag")).distinct()


def frontier_problems(changes: DataFrame) -> DataFrame:
    """Records that break what ``frontier`` needs: no author, or an author's counter used twice."""
    own = F.array_max(F.transform(F.filter("vv", lambda e: e["d"] == F.col("author")), lambda e: e["c"]))
    numbered = changes.select("file_id", "author", "revision_id", own.alias("counter"))
    repeated = (
        numbered.where(F.col("author").isNotNull())
        .groupBy("file_id", "author", "counter")
        .count()
        .where(F.col("count") > 1)
        .select("file_id", "author", "counter", F.lit(REPEATED_COUNTER).alias("flag"))
    )
    absent = numbered.where(F.col("author").isNull()).select(
        "file_id", "author", "counter", F.lit(NO_AUTHOR).alias("flag")
    )
    return repeated.unionByName(absent.distinct())


def frontier_report(changes: DataFrame) -> DataFrame:
    """Number of maximal revisions per file and whether that leaves a conflict open."""
    return frontier(changes).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("heads"), (F.count(F.lit(1)) > 1).alias("conflict")
    )


def conflict_copies(losers: DataFrame, key: str, tag: str = "conflict", existing: DataFrame | None = None) -> DataFrame:
    """Local copies of the revisions that lost a KEEP_BOTH.

    ``losers``: ``file_id, revision_id, path, mtime_ms, vv``. Path and identifiers follow
    from the source alone, so deriving twice gives the same row; copies whose revision is in
    ``existing`` are left out.
    """
    named = losers.withColumn(
        "conflict_path",
        conflict_path(F.col("path"), vv_label(F.col("vv")), F.col("mtime_ms"), F.col("revision_id"), tag),
    )
    parts = [F.col("file_id"), F.col("revision_id"), F.col("conflict_path")]
    derived = named.withColumn(
        "conflict_file_id", ids.uuid_from_digest(ids.joined_id(ids.CONFLICT_FILE, key, *parts))
    ).withColumn(
        "conflict_revision_id",
        ids.uuid_from_digest(ids.joined_id(ids.CONFLICT_REVISION, key, *parts)),
    )
    once = derived.dropDuplicates(["conflict_revision_id"])
    if existing is None:
        return once
    return once.join(existing.select("conflict_revision_id").distinct(), "conflict_revision_id", "left_anti")


def latest_heads(changes: DataFrame, keys: list[str], order: str = "sequence", columns: list[str] | None = None) -> DataFrame:
    """Current row of each key."""
    columns = columns or [c for c in changes.columns if c not in keys]
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), order).alias("_head"))
        .select(*keys, "_head.*")
    )


def live_files(heads: DataFrame) -> DataFrame:
    return heads.where(F.col("kind") == FILE)


def cas_heads(
    heads: DataFrame,
    proposals: DataFrame,
    pending: DataFrame,
    order: str = "position",
    keys: list[str] | None = None,
) -> Fold:
    """Compare-and-swap of heads, proposals of one key in their stated order.

    ``proposals``: keys, ``order`` (a BIGINT, unique in the key), ``content_id, kind,
    expected_previous``. ``pending``: keys and ``target_content_id``. A later proposal sees the
    head an earlier one committed. Nothing is stepped through: see ``chain``.
    """
    keys = keys or ["path_id"]
    waiting = pending.select(*keys, F.col("target_content_id").alias("pending_target"))
    rows = proposals.select(*keys, order, "content_id", "kind", "expected_previous").join(waiting, keys, "left")
    # Read four times: to find what commits and what came before each row.
    rows = materialized(rows)
    blocked = F.col("pending_target").isNotNull() & (F.col("pending_target") != F.col("content_id"))
    committed, _ = committed_rows(rows, heads, keys, order, blocked)
    marked = rows.join(committed.withColumn("_committed", F.lit(True)), [*keys, order], "left").withColumn(
        "_committed", F.coalesce("_committed", F.lit(False))
    )
    state = F.struct("content_id", "kind")
    first = heads.select(*keys, state.alias("_first"))
    met = (
        last_marked(marked, keys, order, F.col("_committed"), state, "_state")
        .join(first, keys, "left")
        .withColumn("_head", F.coalesce("_state", "_first"))
    )
    same = F.col("_head.content_id") == F.col("content_id")
    status = first_status(
        (blocked, "PENDING_OTHER_TARGET"),
        (same & (F.col("_head.kind") == F.col("kind")), "IDEMPOTENT"),
        (same, "KIND_MISMATCH"),
        (~F.col("_committed"), "STALE"),
        otherwise="COMMITTED",
    )
    outcomes = met.select(*keys, order, "content_id", status.alias("status"))
    last = marked.where("_committed").groupBy(*keys).agg(F.max_by(state, order).alias("_last"))
    states = (
        first.join(last, keys, "full_outer")
        .select(*keys, F.coalesce("_last", "_first").alias("state"))
        .where(F.col("state").isNotNull())
    )
    return Fold(lambda: outcomes, lambda: states)
