import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.vv import VV_TYPE
from tidemark.operators import chain
from tidemark.operators import reconcile as rc

LOG = f"sequence bigint, path_id string, file_id string, revision_id string, kind string, author string, vv {VV_TYPE}, content_id string"
HEAD = f"path_id string, file_id string, revision_id string, kind string, vv {VV_TYPE}, content_id string"


def rel(a, b):
    a, b = dict(a), dict(b)
    ahead = any(c > b.get(d, 0) for d, c in a.items())
    behind = any(c > a.get(d, 0) for d, c in b.items())
    return {(0, 0): "EQUAL", (1, 0): "DESCENDANT", (0, 1): "ANCESTOR", (1, 1): "CONCURRENT"}[(ahead, behind)]


def expected(local, incoming):
    """Action and canonical revision; records are (file, revision, kind, vv, content)."""
    if local is None:
        return "USE_INCOMING", None
    if local[0] != incoming[0]:
        return "ERROR_DIFFERENT_FILES", None
    if local[1] == incoming[1]:
        return ("NO_CHANGE" if local[4] == incoming[4] else "ERROR_REVISION_COLLISION"), None
    order = rel(local[3], incoming[3])
    if order in ("ANCESTOR", "DESCENDANT"):
        return {"ANCESTOR": "USE_INCOMING", "DESCENDANT": "KEEP_LOCAL"}[order], None
    wins = (local[3], local[1]) >= (incoming[3], incoming[1])
    kinds = (local[2], incoming[2])
    if kinds == ("FILE", "FILE"):
        return "KEEP_BOTH", local[1] if wins else incoming[1]
    if kinds == ("TOMBSTONE", "TOMBSTONE"):
        return "KEEP_LOCAL" if wins else "USE_INCOMING", None
    return ("KEEP_LOCAL" if kinds[0] == "FILE" else "USE_INCOMING"), None


def test_decision_table_on_all_pairs(spark):
    vectors = [[("a", 1)], [("a", 2)], [("b", 1)], [("a", 1), ("b", 1)]]
    records = [
        ("f1", f"r{i}{kind[0]}", kind, v, f"c{i}{kind[0]}")
        for (i, v), kind in itertools.product(enumerate(vectors), ("FILE", "TOMBSTONE"))
    ] + [("f2", "r9", "FILE", [("a", 1)], "c9"), ("f1", "r0F", "FILE", [("a", 1)], "tampered")]
    pairs = [(a, b) for a in [None, *records] for b in records]
    record = f"struct<file_id:string,revision_id:string,kind:string,vv:{VV_TYPE},content_id:string>"
    df = spark.createDataFrame(pairs, f"l {record}, i {record}")
    for row, (a, b) in zip(df.select(rc.decide(F.col("l"), F.col("i")).alias("d")).collect(), pairs):
        action, canonical = expected(a, b)
        assert (row.d.action, row.d.canonical_revision) == (action, canonical), (a, b)
        if action == "KEEP_BOTH":
            assert {canonical, row.d.conflict_revision} == {a[1], b[1]}


def test_missing_chunks_block_only_decisions_that_need_content(spark):
    heads = spark.createDataFrame(
        [("p1", "f", "r1", "FILE", [("a", 1)], "c1"), ("p2", "f", "r2", "FILE", [("a", 5)], "c2"), ("p3", "f", "r3", "FILE", [("a", 1)], "c3")],
        HEAD,
    )
    incoming = spark.createDataFrame(
        [("p1", "f", "n1", "FILE", [("a", 2)], "x"), ("p2", "f", "n2", "FILE", [("a", 2)], "x"), ("p3", "f", "n3", "FILE", [("b", 2)], "x"), ("p4", "f", "n4", "FILE", [("b", 2)], "x")],
        HEAD,
    )
    missing = spark.createDataFrame([("n1",), ("n2",), ("r3",)], "revision_id string")
    rows = rc.reconcile(heads, incoming, missing=missing).collect()
    assert {r.path_id: r.action for r in rows} == {
        "p1": "MISSING_OBJECTS", "p2": "KEEP_LOCAL", "p3": "MISSING_OBJECTS", "p4": "USE_INCOMING",
    }


def replay(heads, log, me):
    """Sequential replay in plain Python."""
    heads, out = dict(heads), {}
    for seq, path, *record, author in sorted(log):
        if author is None or author == me:
            continue
        action, canonical = expected(heads.get(path), record)
        out[seq] = action
        if action == "USE_INCOMING" or (action == "KEEP_BOTH" and canonical == record[1]):
            heads[path] = record
    return heads, out


def random_log(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        path = "hot" if rng.random() < hot else f"p{rng.randint(0, 6)}"
        vv = sorted({d: rng.randint(1, 6) for d in "abcd" if rng.random() < 0.7}.items()) or [("a", 1)]
        kind = "TOMBSTONE" if rng.random() < 0.2 else "FILE"
        rows.append((seq, path, "f" if rng.random() < 0.98 else "g", f"r{seq:05d}", kind, vv, f"c{seq}", rng.choice(["a", "b", "me", None])))
    return rows


@pytest.mark.parametrize("segment_rows", [2048, 16])
def test_fold_equals_sequential_replay_with_a_hot_path(spark, segment_rows):
    log = random_log(11, 400, 0.5)
    start = {"hot": ["f", "r-", "FILE", [("a", 1)], "c-"], "idle": ["f", "ri", "FILE", [("a", 1)], "ci"]}
    df = spark.createDataFrame([(s, p, f, r, k, a, v, c) for s, p, f, r, k, v, c, a in log], LOG)
    heads = spark.createDataFrame([(p, f, r, k, v, c) for p, (f, r, k, v, c) in start.items()], HEAD)
    fold = rc.fold_heads(heads, df, "me", segment_rows=segment_rows)
    want_heads, want_out = replay(start, log, "me")
    assert {r.sequence: r.action for r in fold.outcomes.collect()} == want_out
    assert {r.path_id: r.state.revision_id for r in fold.states.collect()} == {p: h[1] for p, h in want_heads.items()}
    report = rc.replay_report(fold.outcomes, df, "me").first()
    assert report.records_examined == 400
    assert report.unsigned_records_skipped == sum(r[-1] is None for r in log)
    assert report.records_applied == sum(a == "USE_INCOMING" for a in want_out.values())


def test_fold_is_order_dependent_and_continues_from_stored_heads(spark):
    """Lexicographic order does not extend causality, so arrival order decides."""
    vectors = {"A": [("1", 1), ("2", 5)], "B": [("2", 5)], "C": [("1", 2)]}
    empty = spark.createDataFrame([], HEAD)
    finals = set()
    for order in itertools.permutations("ABC"):
        rows = [(i, "p", "f", n, "FILE", "x", vectors[n], n) for i, n in enumerate(order, 1)]
        log = spark.createDataFrame(rows, LOG)
        whole = rc.fold_heads(empty, log, "me").states.first().state.revision_id
        finals.add(whole)
        first = rc.fold_heads(empty, log.where("sequence <= 2"), "me").states.select("path_id", "state.*")
        assert rc.fold_heads(first, log, "me", folded_through=2).states.first().state.revision_id == whole
    assert finals == {"A", "B", "C"}


def test_frontier_equals_its_definition(spark):
    rng = random.Random(3)
    rows, seq = [], 0
    for file in ("f1", "f2"):
        known = {d: {} for d in "abc"}
        for _ in range(40):
            d = rng.choice("abc")
            if rng.random() < 0.4:
                other = known[rng.choice("abc")]
                known[d] = {k: max(known[d].get(k, 0), other.get(k, 0)) for k in {*known[d], *other}}
            known[d] = {**known[d], d: known[d].get(d, 0) + 1}
            seq += 1
            rows.append((seq, file, file, f"r{seq}", "FILE", d, sorted(known[d].items()), f"c{seq}"))
    want = {
        r[3]
        for r in rows
        if not any(o[2] == r[2] and rel(r[6], o[6]) == "ANCESTOR" for o in rows)
    }
    got = rc.frontier(spark.createDataFrame(rows, LOG)).collect()
    assert {r.revision_id for r in got} == want


def test_conflict_copies_are_derived_once(spark):
    losers = spark.createDataFrame(
        [("f", "aaaaaaaabb", "docs/a.txt", 5, [("device-xyz-123", 2)])] * 2, f"file_id string, revision_id string, path string, mtime_ms bigint, vv {VV_TYPE}"
    )
    copies = rc.conflict_copies(losers, "k")
    row = copies.collect()
    assert len(row) == 1 and row[0].conflict_path == "docs/a (conflict device-devicexy 5 aaaaaaaa).txt"
    assert row[0].conflict_file_id != row[0].conflict_revision_id and row[0].conflict_file_id[12] == "5"
    assert rc.conflict_copies(losers, "k", existing=copies).count() == 0


def test_head_commits_see_the_ones_before(spark):
    heads = spark.createDataFrame([("p", "c0", "FILE")], "path_id string, content_id string, kind string")
    proposals = spark.createDataFrame(
        [
            ("p", 1, "c1", "FILE", "c0"),
            ("p", 2, "cX", "FILE", "c0"),
            ("p", 3, "c2", "TOMBSTONE", "c1"),
            ("p", 4, "c2", "TOMBSTONE", "c1"),
            ("p", 5, "c2", "FILE", "c1"),
            ("q", 1, "n1", "FILE", None),
            ("q", 2, "n2", "FILE", None),
            ("z", 1, "t", "FILE", None),
            ("z", 2, "u", "FILE", None),
        ],
        "path_id string, position bigint, content_id string, kind string, expected_previous string",
    )
    pending = spark.createDataFrame([("z", "u")], "path_id string, target_content_id string")
    fold = rc.cas_heads(heads, proposals, pending)
    got = {(r.path_id, r.position): r.status for r in fold.outcomes.collect()}
    assert got == {
        ("p", 1): "COMMITTED", ("p", 2): "STALE", ("p", 3): "COMMITTED", ("p", 4): "IDEMPOTENT", ("p", 5): "KIND_MISMATCH",
        ("q", 1): "COMMITTED", ("q", 2): "STALE", ("z", 1): "PENDING_OTHER_TARGET", ("z", 2): "COMMITTED",
    }
    assert {r.path_id: r.state.content_id for r in fold.states.collect()} == {"p": "c2", "q": "n1", "z": "u"}


def stepped(proposals, heads, blocked):
    now, out = dict(heads), {}
    for key, at, content, kind, expected in sorted(proposals, key=lambda p: (p[0], p[1])):
        head = now.get(key, (None, None))
        if blocked.get(key) not in (None, content):
            out[key, at] = "PENDING_OTHER_TARGET"
        elif head[0] == content:
            out[key, at] = "IDEMPOTENT" if head[1] == kind else "KIND_MISMATCH"
        elif head[0] != expected:
            out[key, at] = "STALE"
        else:
            out[key, at], now[key] = "COMMITTED", (content, kind)
    return out, now


def test_head_commits_agree_with_stepping(spark):
    rng = random.Random(8)
    proposals = [
        (rng.choice("pqrs"), at, rng.choice("abcd"), rng.choice(["FILE", "TOMBSTONE"]), rng.choice(["a", "b", "c", "d", None]))
        for at in range(0, 400_000, 1000)
    ]
    heads, blocked = {"p": ("a", "FILE"), "x": ("b", "FILE")}, {"s": "c"}
    fold = rc.cas_heads(
        spark.createDataFrame([(k, *v) for k, v in heads.items()], "path_id string, content_id string, kind string"),
        spark.createDataFrame(proposals, "path_id string, position bigint, content_id string, kind string, expected_previous string"),
        spark.createDataFrame(list(blocked.items()), "path_id string, target_content_id string"),
    )
    statuses, final = stepped(proposals, heads, blocked)
    assert {(r.path_id, r.position): r.status for r in fold.outcomes.collect()} == statuses
    assert {r.path_id: tuple(r.state) for r in fold.states.collect()} == final


def test_a_long_chain_takes_few_rounds(spark):
    rows = [("p", k, f"c{k}", f"c{k - 1}" if k else None) for k in range(600)]
    proposals = spark.createDataFrame(rows, "path_id string, position bigint, content_id string, expected_previous string")
    heads = spark.createDataFrame([], "path_id string, content_id string")
    committed, rounds = chain.committed_rows(proposals, heads, ["path_id"], "position", F.lit(False))
    assert committed.count() == 600 and rounds <= 12


def test_maintained_frontier_equals_one_run(spark, tmp_path):
    pick = random.Random(31)
    rows = []
    for k in range(400):
        counters = {d: pick.randint(1, 6) for d in pick.sample("abcd", pick.randint(1, 3))}
        author = pick.choice([*counters, *counters, None])
        rows.append((f"f{pick.randint(0, 7)}", f"r{pick.randint(0, 350)}", author, sorted(counters.items()), k % 5))
    changes = spark.createDataFrame(
        rows, "file_id string, revision_id string, author string, vv array<struct<d: string, c: bigint>>, batch int"
    )
    state = rc.frontier_table(spark, str(tmp_path / "kept"), buckets=16)
    assert rc.kept_frontier(state).collect() == []
    for batch in range(5):
        mine = changes.where(f"batch = {batch}")
        rc.maintain_frontier(state, mine, batch)
        again = rc.maintain_frontier(state, mine, batch)
        assert again == state.version() == batch + 2  # a batch given again makes no version
        so_far = changes.where(f"batch <= {batch}")
        wanted = Counter(map(tuple, rc.frontier(so_far).collect()))
        assert Counter(map(tuple, rc.kept_frontier(state).collect())) == wanted
    some = spark.createDataFrame([("f1",), ("f1",), ("none",)], "file_id string")
    assert Counter(map(tuple, rc.kept_frontier(state, some).collect())) == Counter(
        {row: n for row, n in wanted.items() if row[0] == "f1"}
    )
    before = state.manifest().folders
    rc.maintain_frontier(state, spark.createDataFrame([("f3", "new", "z", [("z", 1)], 9)], changes.schema), 9)
    changed = [b for b, folders in state.manifest().folders.items() if before.get(b) != folders]
    assert len(changed) == 1  # only the bucket of that file is written
    assert ("f3", "z", "new", None) in map(tuple, rc.kept_frontier(state).collect())
