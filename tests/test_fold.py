import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold as fo
from tidemark.operators import reconcile as rc

ROW = "group_id string, path_id string, file_id string, revision_id string, kind string, vv array<struct<d:string,c:bigint>>, content_id string, sequence bigint, author string"


def changes(mode, n, seed, path="p", first=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        names = sorted({rng.choice("abc"), rng.choice("abc")})
        file, vv = "f", [(d, rng.randint(1, 2 + i // 3)) for d in names]
        if mode == "two files":
            file, vv = rng.choice(["fa", "fb"]), [(d, i + rng.randint(1, 3)) for d in names]
        elif mode == "one head stays" and i == 3:
            vv = [(d, 10**6) for d in "abc"]
        at = first + i
        rows.append(("g", path, file, f"{path}{i:05d}", rng.choice(["FILE", "FILE", "TOMBSTONE"]), vv, f"c{i}", at + 1, "z"))
    return rows


@pytest.fixture
def rounds(monkeypatch):
    seen, settle = [], fo.settle

    def spy(*args):
        found = settle(*args)
        seen.append(found[1])
        return found

    monkeypatch.setattr(fo, "settle", spy)
    return seen


def folded(df, none, segment_rows=None, **options):
    fold = rc.fold_heads(none, df, "me", segment_rows=segment_rows, **options)
    outcomes = {(r.path_id, r.sequence): (r.action, r.canonical_revision, r.conflict_revision) for r in fold.outcomes.collect()}
    return outcomes, {r.path_id: r.state.revision_id for r in fold.states.collect()}


@pytest.mark.parametrize("mode", ["two files", "one head stays", "mixed"])
def test_segments_end_as_the_whole_log_does(spark, rounds, mode):
    rows = changes(mode, 200, 1) + changes("mixed", 30, 2, "q", 5000) + changes(mode, 7, 3, "r", 9000)
    df = spark.createDataFrame(rows, ROW)
    missing = df.where("sequence % 9 = 0").select("revision_id")
    whole = folded(df, df.where("false"), missing=missing)
    assert rounds == []
    assert folded(df, df.where("false"), 20, missing=missing) == whole
    assert "MISSING_OBJECTS" in {a for a, _, _ in whole[0].values()}
    # 10 segments; a round per state that no segment offers.
    assert rounds[0] < 10


def test_a_head_that_stays_is_carried_over_many_segments_at_once(spark, rounds):
    df = spark.createDataFrame(changes("one head stays", 200, 4), ROW)
    assert folded(df, df.where("false"), 5) == folded(df, df.where("false"))
    assert rounds[0] <= math.log2(40) + 2


def test_missing_chunks_hold_a_head(spark):
    def row(n, kind, vv, path="p", group="g"):
        return (group, path, "f", f"r{n}", kind, vv, f"c{n}", n, "z")

    rows = [
        row(1, "FILE", [("a", 1)]),
        row(2, "FILE", [("a", 2)]),  # its chunks are absent: the head stays
        row(3, "FILE", [("b", 1)]),  # keeps both with the head
        row(4, "FILE", [("a", 1), ("b", 0)]),
        row(5, "TOMBSTONE", [("a", 9), ("b", 9)]),
        row(6, "FILE", [("a", 1)], group="h"),  # the same path in another group
    ]
    df = spark.createDataFrame(rows, ROW)
    absent = spark.createDataFrame([("r2",)], "revision_id string")
    fold = rc.fold_heads(df.where("false"), df, "me", on=["group_id", "path_id"], missing=absent)
    got = {r.sequence: r.action for r in fold.outcomes.collect()}
    assert [got[k] for k in (1, 2, 3, 5, 6)] == ["USE_INCOMING", "MISSING_OBJECTS", "KEEP_BOTH", "USE_INCOMING", "USE_INCOMING"]
    assert {(r.group_id, r.path_id): r.state.revision_id for r in fold.states.collect()} == {("g", "p"): "r5", ("h", "p"): "r6"}
    # A head whose own chunks are absent cannot be kept beside another record.
    heads = spark.createDataFrame([row(2, "FILE", [("a", 2)])], ROW)
    later = spark.createDataFrame([row(3, "FILE", [("b", 1)])], ROW)
    fold = rc.fold_heads(heads, later, "me", missing=absent)
    assert [r.action for r in fold.outcomes.collect()] == ["MISSING_OBJECTS"]
    assert [r.state.revision_id for r in fold.states.collect()] == ["r2"]
    assert [r.action for r in rc.fold_heads(heads, later, "me", missing=absent.where(F.lit(False))).outcomes.collect()] == ["KEEP_BOTH"]


def test_changes_of_another_file_cost_no_rounds(spark, rounds, monkeypatch):
    """The head stays through the ends of segments, between changes of a file it never takes."""
    monkeypatch.setattr(rc, "LAST_ROWS", 4)
    rows = []
    for i in range(240):
        counter = i + 10 if (i + 1) % 40 < 20 else 1
        rows.append(("g", "p", "fa" if i % 3 == 0 else "fb", f"r{i:04d}", "FILE", [("a", counter)], f"c{i}", i + 1, "z"))
    rows += [(*row[:1], "q", *row[2:]) for row in rows]  # here a head of the other file is stored
    rows += [("g", "n", None if i == 7 else "fa", f"n{i:04d}", "FILE", [("a", i)], f"c{i}", i + 1, "z") for i in range(60)]
    rows += [("g", "o", "fb", f"o{i:04d}", "FILE", [("a", i)], f"c{i}", i + 1, "z") for i in range(60)]  # all idle
    df = spark.createDataFrame(rows, ROW)
    heads = [("g", p, f, "h", "FILE", [("a", 0)], "c", 0, "z") for p, f in (("q", "fb"), ("o", "fa"))]
    heads = spark.createDataFrame(heads, ROW)
    missing = df.where("path_id = 'p' AND sequence < 8").select("revision_id")  # the first able change is not the first
    whole = folded(df, heads, missing=missing)
    assert rounds == []
    assert folded(df, heads, 20, missing=missing) == whole
    assert whole[1]["o"] == "h"
    assert rounds[0] <= 3
