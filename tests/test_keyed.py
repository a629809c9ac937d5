import pytest

from tidemark.operators import changelog, retention
from tidemark.sources import keyed
from tidemark.sources.keyed import KeyedTable

ROW = "k string, v bigint"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def contents(table, version=None):
    return {r.k: r.v for r in table.read(table.manifest(version)).collect()}


def test_a_writer_that_lost_makes_its_change_again(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    KeyedTable.create(rows(spark, ("a", 0), ("b", 0)), base, ["k"], buckets=4)
    first, second = KeyedTable(spark, base), KeyedTable(spark, base)
    write, waiting = first._write, [True]

    def interrupted(*args):
        made = write(*args)
        if waiting.pop() if waiting else False:  # both have read version 1 by now
            second.upsert(rows(spark, ("b", 2), ("c", 2), ("d", 2)))
        return made

    monkeypatch.setattr(first, "_write", interrupted)
    assert first.upsert(rows(spark, ("a", 1), ("c", 1), ("e", 1))) == 3
    assert contents(first) == {"a": 1, "b": 2, "c": 1, "d": 2, "e": 1}
    assert contents(first, 2) == {"a": 0, "b": 2, "c": 2, "d": 2}
    assert contents(first, 1) == {"a": 0, "b": 0}
    assert [first.manifest(v).parent for v in (1, 2, 3)] == [0, 1, 2]


def test_a_taken_version_is_never_replaced(spark, tmp_path):
    base = str(tmp_path / "t")
    table = KeyedTable.create(rows(spark, ("a", 0)), base, ["k"])
    stale = table.manifest()
    table.upsert(rows(spark, ("a", 1)))
    stale.version, stale.parent = 2, 1
    with pytest.raises(keyed.Conflict):
        table._publish(stale)
    assert contents(table) == {"a": 1}
    with pytest.raises(keyed.Conflict):
        KeyedTable.create(rows(spark, ("z", 0)), base, ["k"])


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    table = KeyedTable.create(rows(spark, *((f"k{i}", i) for i in range(200))), str(tmp_path / "t"), ["k"], buckets=16)
    before = table.manifest()
    update = rows(spark, ("k7", -7), ("new", 1))
    touched = table.touched(update, before)
    part = table.read(before, touched)
    assert 1 <= len(touched) <= 2
    assert {f.split("_bucket=")[1].split("/")[0] for f in part.inputFiles()} == {str(b) for b in touched}
    table.upsert(update)
    after = table.manifest()
    assert {int(b) for b in after.folders if after.folders[b] != before.folders.get(b)} == set(touched)
    assert contents(table) == {**{f"k{i}": i for i in range(200)}, "k7": -7, "new": 1}
    assert table.vacuum() == len(touched) and len(contents(table)) == 201


def test_empty_tables_and_null_keys(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([], ROW), str(tmp_path / "t"), ["k"])
    assert contents(table) == {}
    table.upsert(spark.createDataFrame([], ROW))
    table.upsert(rows(spark, (None, 1), ("a", None)))
    assert contents(table) == {None: 1, "a": None}


def test_appends_of_two_writers_stay_dense_and_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_FOLDERS", 2)
    log = spark.createDataFrame([("g", "r0", "m", 40)], "group_id string, revision_id string, content_id string, sequence bigint")
    objects = spark.createDataFrame([("m", "MANIFEST", True)], "content_id string, kind string, available boolean")
    refs = spark.createDataFrame([], "manifest_id string, content_id string")
    base = str(tmp_path / "log")
    one, two = changelog.create_log(log, base, 2), KeyedTable(spark, base)

    def batch(*revisions):
        made = [("g", r, "m", i) for i, r in enumerate(revisions)]
        return spark.createDataFrame(made, "group_id string, revision_id string, content_id string, arrival bigint")

    def statuses(table, *revisions):
        found = changelog.append_to_log(table, batch(*revisions), refs, objects).collect()
        return {r.revision_id: (r.status, r.sequence) for r in found}

    assert statuses(one, "r1", "r0") == {"r1": ("COMMITTED", 41), "r0": ("REPLAYED", 40)}
    publish, seen = one._publish, []

    def late(manifest):
        if not seen:
            seen.append(statuses(two, "r2", "r3"))
        publish(manifest)

    monkeypatch.setattr(one, "_publish", late)
    assert statuses(one, "r3", "r4") == {"r3": ("REPLAYED", 43), "r4": ("COMMITTED", 44)}
    assert seen == [{"r2": ("COMMITTED", 42), "r3": ("COMMITTED", 43)}]
    for k in range(5, 9):
        statuses(one, f"r{k}")
    assert sorted(r.sequence for r in one.read().collect()) == list(range(40, 49))
    assert all(len(folders) <= 2 for folders in one.manifest().folders.values())
    assert one.manifest().facts == {"top": 48}
    hit = one.touched(batch("r5"), one.manifest())
    plan = one.read(one.manifest(), hit)
    assert len(hit) == 1 and all(f"_bucket={hit[0]}/" in f for f in plan.inputFiles())


def test_maintained_counts_drop_what_nothing_pins(spark, tmp_path):
    event = "old_content_id string, new_content_id string"
    counts = KeyedTable.create(spark.createDataFrame([], "content_id string, n bigint"), str(tmp_path / "c"), ["content_id"])
    for batch in ([(None, "a"), (None, "a"), (None, "b")], [("a", "b"), ("b", "b"), (None, None)], [("a", None), (None, "c"), ("c", None)]):
        retention.maintain_counts(counts, spark.createDataFrame(batch, event))
    assert {r.content_id: r.n for r in counts.read().collect()} == {"b": 2}
    objects = spark.createDataFrame([("a",), ("b",)], "content_id string")
    assert {r.content_id: r.reference_count for r in retention.counted_objects(objects, counts).collect()} == {"a": 0, "b": 2}
