from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import functions as F
from test_transfers import brute_force, random_events

from tidemark.functions import ids
from tidemark.operators import admission, changelog
from tidemark.plans import fixtures as fx
from tidemark.plans import logs
from tidemark.session import materialized
from tidemark.streaming import pull as pl
from tidemark.streaming import transfers as stream

def test_transfer_stream_agrees_with_replay_across_restarts(spark, tmp_path):
    """Peers that send the same object meet in one state; a batch that runs again changes nothing."""
    keys = [(p, c) for p in "pq" for c in "xyz"]
    rows = random_events(11, 300, 0.1, 1.5)
    source, base, check = (str(tmp_path / n) for n in ("in", "base", "check"))
    asked = spark.createDataFrame([k for k in keys if k != ("q", "z")], "peer string, content_id string")
    none = spark.createDataFrame([], "content_id string, available boolean")

    def run(checkpoint=check):
        stream.start_transfers(spark, source, base, lambda: asked, lambda: none, checkpoint, 1, True, 2).awaitTermination()

    for part in (rows[:120], rows[120:180], rows[180:]):
        spark.createDataFrame(part, stream.EVENT).coalesce(1).write.mode("append").parquet(source)
        run()
    want, ends = brute_force(rows, [k for k in keys if k != ("q", "z")], [], [])
    assert {s for s, _ in want.values()} >= {"STORED", "ALREADY_PRESENT", "ACCEPTED", "CANCELLED"}

    def outcomes():
        return {r.event_id: (r.status, r.received) for r in stream.read_outcomes(spark, base).collect()}

    assert outcomes() == want
    left = {(r.peer, r.content_id, r.size, r.received) for r in stream.open_state(spark, base).collect() if not r.stored}
    assert left == {(*k, size, received) for k, (_, size, received) in ends.items() if size is not None}
    run(str(tmp_path / "lost"))  # the checkpoint is lost: all batches run again
    assert outcomes() == want


def test_nothing_is_kept_of_what_ended(spark, tmp_path):
    source, base, check = (str(tmp_path / n) for n in ("in", "base", "check"))
    have = []
    rows = [("p", "x", 0, "BEGIN", "q", 4, None, None), ("p", "x", 1, "APPEND", None, None, 0, 4), ("p", "x", 2, "COMPLETE", None, None, None, None),
            ("p", "y", 3, "BEGIN", "q", 4, None, None), ("p", "y", 4, "CANCEL", None, None, None, None)]
    asked = spark.createDataFrame([("p", "x"), ("p", "y")], "peer string, content_id string")

    def run(*events):
        spark.createDataFrame(list(events), stream.EVENT).coalesce(1).write.mode("append").parquet(source)
        objects = spark.createDataFrame([(c, True) for c in have], "content_id string, available boolean")
        stream.start_transfers(spark, source, base, lambda: asked, lambda: objects, check, available_now=True).awaitTermination()
        return [(r.content_id, r.stored) for r in stream.open_state(spark, base).collect()]

    assert run(*rows) == [("x", True)]  # until the catalog has it
    have.append("x")
    assert run(("p", "x", 5, "BEGIN", "q", 4, None, None)) == []
    assert {r.event_id: r.status for r in stream.read_outcomes(spark, base).collect()}[5] == "ALREADY_PRESENT"


@pytest.fixture
def peer(spark):
    """Change records of a peer and the local tables an admission looks at."""

    def change(n, group="g", author="d1", wrong=False):
        tag = F.lit("wrong") if wrong else ids.change_tag(
            F.lit("key-" + author), F.lit(group), F.lit(author), F.lit(f"r{n}"), F.lit(f"m{n}")
        )
        return spark.range(1).select(
            F.lit(group).alias("group_id"), F.lit(n).cast("bigint").alias("sequence"), F.lit(f"r{n}").alias("revision_id"),
            F.lit(f"r{n}").alias("manifest_revision_id"), F.lit(f"m{n}").alias("content_id"), F.lit(author).alias("author"), tag.alias("tag"),
        )

    have = {f"m{n}": "MANIFEST" for n in range(1, 9)} | {"c1": "CHUNK"}
    members = spark.createDataFrame([("g", "d1", "key-d1", "ACTIVE"), ("g", "peer", "key-peer", "ACTIVE"), ("g", "off", "k", "REVOKED")], "group_id string, device string, tag_key string, status string")
    provenance = spark.createDataFrame([], "group_id string, revision_id string, content_id string, author string, tag string")
    local = pl.Tables(
        refs=lambda: spark.createDataFrame([("m1", "c1"), ("m2", "c2")], "manifest_id string, content_id string"),
        objects=lambda: spark.createDataFrame([(c, k, True) for c, k in have.items()], "content_id string, kind string, available boolean"),
        members=lambda: members,
        provenance=lambda: provenance,
    )
    return change, have, local


def test_pages_stop_the_cursor_at_the_first_incomplete_one(spark, peer):
    change, have, local = peer
    remote = change(1)
    for n in (2, 3, 4, 5, 6):
        remote = remote.unionByName(change(n))
    log = spark.createDataFrame([], "group_id string, revision_id string, content_id string, sequence bigint")

    def pull(after, peer_name="peer", n=2):
        admitted, verdicts = pl.pull_pages(remote, log, local, "g", peer_name, after, n)
        statuses = {r.revision_id: r.status for r in admitted.collect()}
        return statuses, tuple(pl.next_cursor(verdicts, after).first())

    statuses, cursor = pull(0)
    assert statuses == {"r1": "COMMITTED", "r2": "WAITING", "r3": "COMMITTED", "r4": "COMMITTED", "r5": "COMMITTED", "r6": "COMMITTED"}
    assert cursor == (0, True)
    assert pull(2)[1] == (6, False)
    assert pull(0, n=1)[1] == (1, False)
    assert set(pull(0, "off")[0].values()) == {"PEER_REVOKED"}
    assert set(pull(0, "who")[0].values()) == {"UNKNOWN_PEER"}
    have["c2"] = "CHUNK"
    assert pull(0)[1] == (6, False)


def test_pull_stream_is_harmless_to_repeat_and_retries_waiting_records(spark, peer, tmp_path):
    change, have, local = peer
    source, base, check = (str(tmp_path / n) for n in ("in", "base", "check"))

    def offer(*rows):
        for row in rows:
            row.coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint=check):
        pl.start_pull(spark, source, base, "g", "peer", local, checkpoint, files_per_trigger=2, available_now=True).awaitTermination()
        rows = spark.read.parquet(f"{base}/log").where("batch >= 0").collect()
        assert len({r.revision_id for r in rows}) == len(rows)
        return {r.revision_id: r.sequence for r in rows}

    offer(change(1), change(2), change(3, wrong=True), change(4))
    first = run()
    assert set(first) == {"r1", "r4"} and sorted(first.values()) == [1, 2]
    assert run() == first
    have["c2"] = "CHUNK"
    offer(change(4), change(5))
    second = run()
    assert set(second) == {"r1", "r2", "r4", "r5"} and sorted(second.values()) == [1, 2, 3, 4]
    assert {r: s for r, s in second.items() if r in first} == first
    # The record with a wrong tag is kept once and not tried again.
    rejected = spark.read.parquet(f"{base}/rejected").collect()
    assert [(r.revision_id, r.status) for r in rejected] == [("r3", "INVALID")]
    assert spark.read.parquet(f"{base}/waiting").where("revision_id = 'r3'").count() == 0


def test_a_refused_record_commits_when_its_author_is_added(spark, peer, tmp_path):
    change, _, local = peer
    source, base, check = (str(tmp_path / n) for n in ("in", "base", "check"))
    known = [local.members()]
    local = replace(local, members=lambda: known[0])

    def run():
        pl.start_pull(spark, source, base, "g", "peer", local, check, available_now=True).awaitTermination()
        return {r.revision_id for r in spark.read.parquet(f"{base}/log").where("batch >= 0").collect()}

    change(3).unionByName(change(4, author="late")).coalesce(1).write.mode("append").parquet(source)
    assert run() == {"r3"}
    late = spark.createDataFrame([("g", "late", "key-late", "ACTIVE")], known[0].schema)
    known[0] = known[0].unionByName(late)
    change(5).coalesce(1).write.mode("append").parquet(source)
    assert run() == {"r3", "r4", "r5"}


def test_change_files_of_a_peer_are_written_in_many_tasks(spark, monkeypatch):
    class Stop(Exception):
        pass

    def start(session, source, *rest, **more):
        raise Stop(len(session.read.parquet(source).inputFiles()))

    table = fx.table
    monkeypatch.setattr(fx, "table", lambda *at: table(*at).repartition(8))
    monkeypatch.setattr(pl, "start_pull", start)
    with pytest.raises(Stop) as stopped:
        logs.pull_stream(spark, "/root/testdata/sf0.001")
    assert stopped.value.args == (8,)


def test_admission_writes_its_records_twice(spark, peer, monkeypatch):
    """What the log says of them is met where the authentication is, not in a step of its own."""
    change, _, local = peer
    written = []

    def kept(df):
        written.append("revision_id" in df.columns)
        return materialized(df)

    for module in (admission, changelog):
        monkeypatch.setattr(module, "materialized", kept)
    log = spark.createDataFrame([("g", "r4", "m4", 7), ("g", "r5", "other", 8)], "group_id string, revision_id string, content_id string, sequence bigint")
    remote = reduce(lambda a, b: a.unionByName(b), [change(n) for n in range(1, 6)])
    admitted, _ = pl.pull_pages(remote, log, local, "g", "peer", 0)
    assert {r.revision_id: (r.status, r.sequence) for r in admitted.collect()} == {
        "r1": ("COMMITTED", 9), "r2": ("WAITING", None), "r3": ("COMMITTED", 10), "r4": ("REPLAYED", 7), "r5": ("REVISION_CONTENT_MISMATCH", None)
    }
    assert sum(written) == 2
