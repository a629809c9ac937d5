from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import admission, exchange, reports
from tidemark.session import materialized

MEMBER = "group_id bigint, device string, status string, tag_key string"


def hexed(kind, k):
    return f"{kind}{k:031d}"


def setting(spark, lacking=(), payload=lambda k: 10):
    """Twelve records of author ``x`` at peer ``p``; record k has the chunks ck and c0."""
    rows = [(1, k, hexed("a", k), hexed("a", k), f"m{k}", "x", payload(k)) for k in range(1, 13)]
    remote = spark.createDataFrame(
        rows, "group_id bigint, sequence bigint, revision_id string, manifest_revision_id string, content_id string, author string, bytes bigint"
    )
    tag = ids.change_tag(F.lit("key"), F.col("group_id"), F.col("author"), F.col("revision_id"), F.col("content_id"))
    remote = remote.withColumn("tag", tag)
    sent = F.sha2("content_id", 256)
    envelopes = remote.select(
        "sequence", "revision_id", sent.alias("content_id"), F.lit(hexed("b", 1)).alias("author"), F.repeat(F.lit("c"), 128).alias("tag"),
        F.col("bytes").alias("payload_bytes"), F.lit("MANIFEST").alias("payload_kind"), sent.alias("payload_content_id"),
    )
    refs = spark.createDataFrame(
        [(f"m{k}", c) for k in range(1, 13) for c in (f"c{k}", "c0")], "manifest_id string, content_id string"
    )
    objects = spark.createDataFrame(
        [(f"c{k}", "CHUNK", k not in lacking) for k in range(13)], "content_id string, kind string, available boolean"
    )
    members = spark.createDataFrame([(1, "x", "ACTIVE", "key"), (1, "p", "ACTIVE", "key2")], MEMBER)
    log = spark.createDataFrame([], "group_id bigint, revision_id string, content_id string, sequence bigint")
    known = spark.createDataFrame([], "group_id bigint, revision_id string, content_id string, author string, tag string")
    return remote.drop("bytes"), envelopes, exchange.Catalog(refs, objects, members), exchange.new_state(spark, log, known)


def cursor(state):
    return {r.peer: r.sequence for r in state.progress.collect()}


def statuses(admitted):
    return {int(r.revision_id[1:]): r.status for r in admitted.collect()}


def test_round_again_and_nothing_new(spark):
    remote, envelopes, catalog, state = setting(spark)
    first, verdicts, state = exchange.pull_round(remote, envelopes, catalog, state, 1, "p", 5, n=5)
    assert set(statuses(first).values()) == {"COMMITTED"} and len(statuses(first)) == 12
    assert [r.accepted_through for r in verdicts.orderBy("page_id").collect()] == [5, 10, 12]
    assert cursor(state) == {"p": 12} and sorted(r.sequence for r in state.log.collect()) == list(range(1, 13))
    assert state.provenance.count() == 12
    again, _, after = exchange.pull_round(remote, envelopes, catalog, state, 1, "p", 6, n=5)
    assert again.count() == 0 and cursor(after) == {"p": 12} and after.log.count() == 12
    replayed, _, after = exchange.pull_round(
        remote, envelopes, catalog, replace(state, progress=state.progress.limit(0)), 1, "p", 6, n=5
    )
    assert set(statuses(replayed).values()) == {"REPLAYED"} and after.log.count() == 12 and after.provenance.count() == 12


def test_page_that_breaks_a_rule_stops_the_round(spark):
    too_large = admission.MAXIMUM_PAYLOAD_BYTES + 1
    remote, envelopes, catalog, state = setting(spark, payload=lambda k: too_large if k == 7 else 10)
    admitted, verdicts, state = exchange.pull_round(remote, envelopes, catalog, state, 1, "p", 5, n=5)
    assert sorted(statuses(admitted)) == [1, 2, 3, 4, 5] and cursor(state) == {"p": 5}
    assert [(r.page_id, r.error) for r in verdicts.orderBy("page_id").collect()] == [
        (1, None), (2, "PAYLOAD_TOO_LARGE"), (3, None)
    ]
    lost = envelopes.where("sequence <> 1")
    _, _, _, fresh = setting(spark)
    admitted, _, after = exchange.pull_round(remote, lost, catalog, fresh, 1, "p", 5, n=5)
    assert admitted.count() == 0 and cursor(after) == {"p": 0}


def test_waiting_records_commit_when_their_objects_arrive(spark):
    remote, envelopes, catalog, state = setting(spark, lacking=(3, 8))
    admitted, _, state = exchange.pull_round(remote, envelopes, catalog, state, 1, "p", 5, n=5)
    assert {k for k, s in statuses(admitted).items() if s == "WAITING"} == {3, 8}
    assert cursor(state) == {"p": 0}  # the first page waits
    assert {(r.peer, r.content_id, r.requested_at_ms) for r in state.requests.collect()} == {("p", "c3", 5), ("p", "c8", 5)}
    again, _, state = exchange.pull_round(remote, envelopes, catalog, state, 1, "p", 9, n=5)
    assert state.requests.count() == 2 and state.waiting.count() == 2 and state.index.count() == 2

    revoked = catalog.members.withColumn("status", F.when(F.col("device") == "x", "REVOKED").otherwise(F.col("status")))
    objects = catalog.objects.withColumn("available", F.col("available") | (F.col("content_id") == "c3"))
    now = exchange.Catalog(catalog.refs, objects, revoked)
    arrived = spark.createDataFrame([(1, "c3"), (1, "c3"), (1, "unknown")], "group_id bigint, content_id string")
    woken, state = exchange.retry_waiting(now, state, arrived, 1, "p")
    # Its author is revoked by now, but was authenticated when the record came.
    assert statuses(woken) == {3: "COMMITTED"}
    assert [r.sequence for r in woken.collect()] == [11] and state.log.count() == 11
    assert [r.content_id for r in state.requests.collect()] == ["c8"] and state.waiting.count() == 1
    nothing, state = exchange.retry_waiting(now, state, arrived, 1, "p")
    assert nothing.count() == 0 and state.waiting.count() == 1 and state.log.count() == 11
    other, _ = exchange.retry_waiting(now, state, arrived, 1, "q")
    assert other.count() == 0


def test_two_peers_wait_for_one_object(spark):
    remote, envelopes, catalog, state = setting(spark, lacking=(3,))
    members = catalog.members.union(spark.createDataFrame([(1, "q", "ACTIVE", "key3")], MEMBER))
    catalog = replace(catalog, members=members)
    for peer in ("p", "q"):
        _, _, state = exchange.pull_round(remote, envelopes, catalog, state, 1, peer, 5)
    assert state.waiting.count() == 2 and state.requests.count() == 2 and state.index.count() == 1
    catalog = replace(catalog, objects=catalog.objects.withColumn("available", F.lit(True)))
    arrived = spark.createDataFrame([(1, "c3")], "group_id bigint, content_id string")
    first, state = exchange.retry_waiting(catalog, state, arrived, 1, "p")
    second, state = exchange.retry_waiting(catalog, state, arrived, 1, "q")
    assert statuses(first) == {3: "COMMITTED"} and statuses(second) == {3: "REPLAYED"}
    assert state.waiting.count() == state.requests.count() == state.index.count() == 0


def test_empty_page_keeps_the_cursor(spark):
    pages = spark.createDataFrame(
        [(1, True, 40, 7), (2, False, 40, 7)], "page_id bigint, has_more boolean, high_watermark bigint, after_sequence bigint"
    )
    none = spark.createDataFrame([], "page_id bigint, status string, peer_sequence bigint")
    found = {r.page_id: r.accepted_through for r in admission.page_verdicts(none, pages).collect()}
    assert found == {1: 7, 2: 40}


def test_reports_carry_cursors_and_replay(spark):
    events = spark.createDataFrame([("p", "PAGE", None), ("q", "FAILED", None)], "peer string, kind string, bytes bigint")
    progress = spark.createDataFrame([("p", 9), ("p", 4)], "peer string, sequence bigint")
    rows = {r.peer: r.peer_high_watermark for r in reports.pull_report(events, progress).collect()}
    assert rows == {"p": 9, "q": 0}
    replay = spark.createDataFrame([(3,)], "records_applied bigint")
    row = reports.sync_report(reports.pull_report(events), replay).first()
    assert (row.peers_synchronized, row.peers_failed, row.records_applied) == (1, 1, 3)


def test_refused_pages_are_not_written_and_few_manifests_are_looked_up_once(spark, monkeypatch):
    """Of pages behind a refused one only sequences are kept, and references that no record names are read once."""
    written = []

    def kept(df):
        table = materialized(df)
        written.append((set(table.columns), table.count()))
        return table

    too_large = admission.MAXIMUM_PAYLOAD_BYTES + 1
    remote, envelopes, catalog, state = setting(spark, lacking=(3,), payload=lambda k: too_large if k == 7 else 10)
    monkeypatch.setattr(exchange, "materialized", kept)
    admitted, _, state = exchange.pull_round(remote, envelopes, catalog, state, 1, "p", 5, n=5)
    assert statuses(admitted) == {k: "WAITING" if k == 3 else "COMMITTED" for k in range(1, 6)}
    assert max(rows for columns, rows in written if "tag" in columns) == 5
    assert [rows for columns, rows in written if columns == {"manifest_id", "content_id"}] == [10]
    assert [r.content_id for r in state.requests.collect()] == ["c3"] and state.index.count() == 1


def test_many_manifests_keep_the_whole_catalog(spark, monkeypatch):
    _, _, catalog, _ = setting(spark)
    manifests = spark.createDataFrame([("m1",), ("m2",)], "content_id string")
    assert exchange.narrowed(catalog, manifests).refs.count() == 4
    monkeypatch.setattr(exchange, "GROUP_ROWS", 1)
    assert exchange.narrowed(catalog, manifests) is catalog
