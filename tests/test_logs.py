import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admission, changelog, diff, members, ranking, reports, requests, retention, transfers
from tidemark.sources import tables

BATCH = "group_id string, revision_id string, content_id string, arrival bigint"
LOG = "group_id string, revision_id string, content_id string, sequence bigint"
OBJECT = "content_id string, kind string, available boolean"
EVENT = "peer string, content_id string, event_id bigint, op string, request_id string, size bigint, start_offset bigint, len bigint"


def test_ranks_are_dense_over_sparse_and_huge_order_values(spark):
    rng = random.Random(5)
    values = {rng.randint(0, 2**62) for _ in range(300)} | {rng.randint(0, 5000) for _ in range(300)} | set(range(2**40, 2**40 + 100))
    rows = [(v % 3 == 0, v) for v in values]
    df = spark.createDataFrame(rows, "g boolean, v bigint")
    for by, group in (([], lambda r: 0), (["g"], lambda r: r[0])):
        want = {}
        for key in {group(r) for r in rows}:
            want.update({r: i for i, r in enumerate(sorted((r for r in rows if group(r) == key), key=lambda r: r[1]), 1)})
        ranked = ranking.dense_rank(df, "v", by=by)
        assert {(r.g, r.v): r["rank"] for r in ranked.collect()} == want


def test_ranks_of_negative_and_null_orders(spark):
    rows = [(k, v) for k in ("a", None) for v in (None, -70_000, -1, 0, 5, 70_000)]
    ranked = ranking.dense_rank(spark.createDataFrame(rows, "k string, v bigint"), "v", by=["k"]).collect()
    for key in ("a", None):
        mine = sorted((r for r in ranked if r.k == key), key=lambda r: (r.v is not None, r.v or 0))
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5, 6]


def test_ranks_break_ties_by_the_rest_of_the_order(spark):
    rows = [(k, v % 5, v) for v in range(90) for k in ("hot", "hot", f"k{v % 9}")]
    df = spark.createDataFrame([(k, o, v, i) for i, (k, o, v) in enumerate(rows)], "k string, o bigint, v int, i int")
    got = ranking.dense_rank(df, "o", by=["k"], ties=["v", "i"]).collect()
    for key in {r.k for r in got}:
        mine = sorted((r for r in got if r.k == key), key=lambda r: (r.o, r.v, r.i))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_previous_row_crosses_cells(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), v) for v in rng.sample(range(-50_000, 50_000), 300)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    for cell_rows in (1 << 16, 1000, 64):
        linked = ranking.previous_row(df, ["k"], "v", [], cell_rows=cell_rows).collect()
        got = {(r.k, r.v): r.previous and r.previous.v for r in linked}
        for key in "ab":
            ordered = sorted(v for k, v in rows if k == key)
            assert [got[key, v] for v in ordered] == [None, *ordered[:-1]]


def test_append_is_idempotent_and_dense(spark):
    objects = spark.createDataFrame(
        [("m1", "MANIFEST", True), ("m2", "MANIFEST", True), ("c1", "CHUNK", True), ("c2", "CHUNK", False), ("m3", "MANIFEST", True), ("bad", "CHUNK", True), ("m4", "MANIFEST", True)],
        OBJECT,
    )
    refs = spark.createDataFrame([("m1", "c1"), ("m1", "c1"), ("m3", "c2"), ("m4", "m2")], "manifest_id string, content_id string")
    batch = spark.createDataFrame(
        [("g", "r1", "m1", 10), ("g", "r1", "m1", 11), ("g", "r1", "m2", 12), ("g", "r2", "m2", 13), ("g", "r3", "m3", 14), ("g", "r4", "bad", 15), ("g", "r5", "m4", 16), ("g", "r6", "none", 9), ("h", "r1", "m2", 20), ("g", "r3", "m2", 21)],
        BATCH,
    )
    log = spark.createDataFrame([("g", "old", "m1", 41)], LOG)
    out = changelog.append_changes(log, batch, refs, objects)
    got = {r.arrival: (r.status, r.sequence) for r in out.collect()}
    assert got == {
        10: ("COMMITTED", 42), 11: ("REPLAYED", 42), 12: ("REVISION_CONTENT_MISMATCH", None), 13: ("COMMITTED", 43),
        14: ("OBJECT_NOT_FOUND", None), 15: ("OBJECT_KIND_MISMATCH", None), 16: ("OBJECT_KIND_MISMATCH", None), 9: ("OBJECT_NOT_FOUND", None), 20: ("COMMITTED", 44), 21: ("COMMITTED", 45),
    }
    grown = log.unionByName(out.where("status = 'COMMITTED'").select(*log.columns))
    again = {r.arrival: (r.status, r.sequence) for r in changelog.append_changes(grown, batch, refs, objects).collect()}
    assert again[10] == ("REPLAYED", 42) and again[13] == ("REPLAYED", 43)
    assert not any(status == "COMMITTED" for status, _ in again.values())


def test_pages_of_a_short_log(spark):
    log = spark.createDataFrame([("g", "r1", "c1", 1), ("h", "x", "x", 2), ("g", "r2", "c2", 3)], LOG)
    signed = spark.createDataFrame([("g", "r1", "c1", "a", "t"), ("g", "r2", "zz", "a", "t")], "group_id string, revision_id string, content_id string, author string, tag string")

    def summary(group, after, n):
        return tuple(changelog.change_page(log, signed, group, after, n)[1].first())

    assert summary("g", 0, 1) == (1, 1, 3, True, None)
    assert summary("g", 1, 1) == (1, 3, 3, False, "PROVENANCE_CONTENT_MISMATCH")
    assert summary("g", 3, 1) == (0, None, 3, False, None)
    assert summary("h", 0, 5) == (1, 2, 2, False, "UNSIGNED_CHANGE")
    assert summary("none", 0, 5) == (0, None, 0, False, None)


def test_watermarks_never_move_back(spark):
    schema = "group_id string, peer string, sequence bigint"
    progress = spark.createDataFrame([("g", "p", 7)], schema)
    moved = admission.advance_watermark(progress, spark.createDataFrame([("g", "p", 3), ("g", "q", 2)], schema))
    assert {(r.peer, r.sequence) for r in moved.collect()} == {("p", 7), ("q", 2)}
    peers = spark.createDataFrame([("g", "p"), ("g", "new")], "group_id string, peer string")
    assert {(r.peer, r.sequence) for r in admission.watermark_of(moved, peers).collect()} == {("p", 7), ("new", 0)}


def test_registry_lifecycle(spark):
    empty = spark.createDataFrame([], "group_id string, device string, tag_key string, role string, status string, added_at_ms bigint, revoked_at_ms bigint")
    ask = "group_id string, device string, tag_key string, role string, position bigint"
    first = members.member_additions(empty, spark.createDataFrame([("g", "d", "k", "MEMBER", 1), ("g", "d", "k", "MEMBER", 2), ("g", "d", "k", "OWNER", 3), ("g", "d", "z", "OWNER", 4)], ask))
    assert [r.status for r in first.orderBy("position").collect()] == ["ADDED", "ALREADY_ACTIVE", "ROLE_MISMATCH", "KEY_MISMATCH"]
    registry = members.add_members(empty, first, 5)
    devices = spark.createDataFrame([("g", "d"), ("g", "unknown")], "group_id string, device string")
    revoked = members.revoke_members(registry, devices, 9)
    assert [tuple(r) for r in revoked.select("device", "status", "revoked_at_ms", "changed").collect()] == [("d", "REVOKED", 9, True)]
    twice = members.revoke_members(revoked.drop("changed"), devices, 12)
    assert [tuple(r) for r in twice.select("revoked_at_ms", "changed").collect()] == [(9, False)]
    back = members.member_additions(revoked, spark.createDataFrame([("g", "d", "k", "MEMBER", 1)], ask))
    assert back.first().status == "REVOKED" and members.member_errors(revoked).count() == 0


def test_top_per_key_keeps_the_first_of_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("peer"),
        F.lit("g").alias("group_id"),
        F.col("id").cast("string").alias("content_id"),
        (5000 - F.col("id")).alias("requested_at_ms"),
    )
    got = requests.pending_requests(df, 3).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.peer, []).append((r.requested_at_ms, r.content_id))
    assert {(r.peer, r.position, r.content_id) for r in got} == {
        (p, i, c) for p, rows in want.items() for i, (_, c) in enumerate(sorted(rows)[:3], 1)
    }
    assert requests.pending_requests(df, 0).count() == 0


def test_gc_needs_more_passes_than_a_sweep(spark):
    objects = spark.createDataFrame([("m1", 5, 10), ("m2", 5, 10), ("c1", 1, 10), ("c2", 1, 10), ("c3", 1, 99)], "content_id string, size bigint, verified_at_ms bigint")
    edges = spark.createDataFrame([("m1", "c1"), ("m2", "c1"), ("m2", "c2")], "owner_id string, content_id string")
    changes = spark.createDataFrame([("m1",)], "content_id string")
    counted = retention.reference_counts(objects, changes=changes, edges=edges)
    assert {r.content_id: r.reference_count for r in counted.collect()} == {"m1": 1, "m2": 0, "c1": 2, "c2": 1, "c3": 0}
    assert [r.content_id for r in retention.gc_candidates(counted, 50, 9).collect()] == ["m2"]
    assert retention.gc_candidates(counted, 50, 0).count() == 0
    assert tuple(retention.gc_report(retention.gc_candidates(counted, 100, 1)).first()) == (1, 5)
    assert {r.content_id for r in retention.gc_sweep(objects, changes, edges, 50).collect()} == {"m2", "c2"}


def test_audits(spark):
    catalog = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "content_id string, available boolean")
    files = spark.createDataFrame([("a", 1), ("x", 2)], "content_id string, length bigint")
    audit = retention.audit_catalog(catalog, files)
    assert {r.content_id: r.status for r in audit.collect()} == {"a": "OK", "b": "DEMOTE", "c": "ABSENT", "x": "ORPHAN"}
    assert {r.content_id: r.available for r in retention.demote(catalog, audit).collect()} == {"a": True, "b": False, "c": False}


def test_transfer_rules(spark):
    size = 10
    steps = [
        ("APPEND", None, None, 0, 5, "NOT_FOUND"),
        ("BEGIN", "0" * 32, size, None, None, "NIL_REQUEST"),
        ("BEGIN", "q", 0, None, None, "SIZE_OUT_OF_RANGE"),
        ("BEGIN", "q", size, None, None, "START"),
        ("APPEND", None, None, 0, 4, "ACCEPTED"),
        ("APPEND", None, None, 0, 4, "OFFSET_MISMATCH"),
        ("APPEND", None, None, 4, 0, "NOOP"),
        ("BEGIN", "q2", size, None, None, "RESUME"),
        ("BEGIN", "q2", size + 1, None, None, "SIZE_MISMATCH"),
        ("APPEND", None, None, 4, 7, "EXCEEDS_SIZE"),
        ("COMPLETE", None, None, None, None, "INCOMPLETE"),
        ("APPEND", None, None, 4, 6, "ACCEPTED"),
        ("COMPLETE", None, None, None, None, "STORED"),
        ("BEGIN", "q", size, None, None, "ALREADY_PRESENT"),
        ("CANCEL", None, None, None, None, "NOTHING_TO_CANCEL"),
    ]
    rows = [("p", "x", i, *s[:5]) for i, s in enumerate(steps)] + [("p", "other", 99, "BEGIN", "q", size, None, None)]
    events = spark.createDataFrame(rows, EVENT)
    asked = spark.createDataFrame([("p", "x")], "peer string, content_id string")
    none = spark.createDataFrame([], "content_id string, available boolean")
    for segment_rows in (None, 3):
        fold = transfers.replay_transfers(events, asked, none, segment_rows=segment_rows)
        got = {(r.content_id, r.event_id): r.status for r in fold.outcomes.collect()}
        assert got.pop(("other", 99)) == "NOT_REQUESTED"
        assert [got["x", i] for i in range(len(steps))] == [s[5] for s in steps]
        assert {r.content_id: r.progress for r in transfers.transfer_progress(fold.states).collect()} == {"x": "COMPLETE", "other": "IDLE"}
    resumed = transfers.replay_transfers(
        spark.createDataFrame([("p", "x", 1, "APPEND", None, None, 4, 6)], EVENT), asked, none,
        spark.createDataFrame([("p", "x", 10, 4)], "peer string, content_id string, size bigint, received bigint"),
    )
    assert tuple(resumed.outcomes.first()[-2:]) == ("ACCEPTED", 10)


def test_directory_lifecycle(spark):
    head = "path_id string, kind string, file_id string, vv array<struct<d:string,c:bigint>>, display string, size bigint, mtime_ms bigint, chunks_digest string"
    entry = "path_id string, display string, size bigint, mtime_ms bigint, chunks_digest string"
    heads = spark.createDataFrame([], head)
    seen = []
    for now, listing in enumerate(
        [[("p", "A", 1, 5, "x")], [("p", "A", 1, 5, "x")], [("p", "A", 2, 5, "y")], [], [], [("p", "a", 2, 5, "y")], [("p", "A", 2, 5, "y")], [("p", "A", 2, 6, "y")]], 1
    ):
        change = diff.snapshot_diff(heads, spark.createDataFrame(listing, entry), "me", now, "k")
        rows = change.collect()
        seen.append([(r.change, r.reason, [tuple(e) for e in r.vv]) for r in rows])
        if rows and rows[0].change != "UNCHANGED":
            new = change.select("path_id", "kind", "file_id", "vv", "display", "size", "mtime_ms", "chunks_digest")
            heads = spark.createDataFrame(new.collect(), head)
    assert seen == [
        [("NEW", None, [("me", 1)])],
        [("UNCHANGED", None, [("me", 1)])],
        [("MODIFIED", "CONTENT", [("me", 2)])],
        [("DELETED", None, [("me", 3)])],
        [],
        [("RESTORED", None, [("me", 4)])],
        [("MODIFIED", "CASE_RENAME", [("me", 5)])],
        [("MODIFIED", "TOUCH", [("me", 6)])],
    ]


def test_gate_holds_back_the_whole_diff(spark):
    members_ = spark.createDataFrame([("me", "ACTIVE"), ("gone", "REVOKED")], "device string, status string")
    none = spark.createDataFrame([], "x int")
    listing = "path string, path_key string, path_error string"
    clean = spark.createDataFrame([("a", "a", None)], listing)
    dirty = spark.createDataFrame([("a", "a", None), ("A", "a", None), ("b/", "b/", "NOT_RELATIVE")], listing)
    change = spark.createDataFrame([("p",)], "path_id string")

    def reasons(me, pending, rows):
        gate = diff.diff_gate(members_, me, pending, rows)
        return sorted(r.violation for r in gate.collect()), diff.gated(change, gate).count()

    assert reasons("me", none, clean) == ([], 1)
    assert reasons("who", none, clean) == (["UNKNOWN_MEMBER"], 0)
    assert reasons("gone", spark.range(2), dirty) == (["INVALID_PATH", "PATH_COLLISION", "PENDING_MATERIALIZATION", "REVOKED"], 0)


@pytest.mark.parametrize("mode, kept", [(tables.UPDATE, {"a": 3, "b": 1, "c": 9}), (tables.NOTHING, {"a": 0, "b": 1, "c": 8})])
def test_upsert_versions(spark, tmp_path, mode, kept):
    base = str(tmp_path / "table")
    start = spark.createDataFrame([("a", 0), ("b", 1)], "k string, v int")
    assert tables.current_version(spark, base) == 0
    assert tables.write_version(start, base) == 1
    updates = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 8, 1), ("c", 9, 2)], "k string, v int, at int")
    assert tables.write_version(tables.upsert(tables.read_table(spark, base), updates, ["k"], mode, "at"), base) == 2
    assert {r.k: r.v for r in tables.read_table(spark, base).collect()} == kept


def test_serve_report(spark):
    rows = spark.createDataFrame([("p", "PAGE_SENT", 0), ("p", "OBJECT_SENT", 7), ("p", "ACKNOWLEDGED", 0)], "peer string, kind string, bytes bigint")
    assert tuple(reports.serve_report(rows).first()) == ("p", 1, 1, 7, 1)


def test_an_object_one_peer_stored_is_there_for_all(spark):
    def event(peer, at, op, request=None, size=None, offset=None, length=None):
        return (peer, "x", at, op, request, size, offset, length)

    rows = [
        event("p", 1, "BEGIN", "r1", 4), event("q", 2, "BEGIN", "r2", 4), event("q", 3, "APPEND", offset=0, length=2),
        event("p", 4, "APPEND", offset=0, length=4), event("p", 5, "COMPLETE"), event("q", 6, "APPEND", offset=2, length=2),
        event("q", 7, "COMPLETE"), event("q", 8, "BEGIN", "r3", 4), event("r", 9, "BEGIN", "r4", 4), event("r", 10, "CANCEL"),
    ]
    events = spark.createDataFrame(rows, EVENT)
    asked = spark.createDataFrame([(p, "x") for p in "pqr"], "peer string, content_id string")
    none = spark.createDataFrame([], "content_id string, available boolean")
    fold = transfers.replay_transfers(events, asked, none)
    assert [r.status for r in sorted(fold.outcomes.collect(), key=lambda r: r.event_id)] == [
        "START", "START", "ACCEPTED", "ACCEPTED", "STORED", "NOT_FOUND", "NOT_FOUND", "ALREADY_PRESENT", "ALREADY_PRESENT", "NOTHING_TO_CANCEL",
    ]
    assert {r.progress for r in transfers.transfer_progress(fold.states).collect()} == {"COMPLETE"}
