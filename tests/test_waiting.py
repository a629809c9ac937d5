import random

from pyspark.sql import functions as F

from tidemark.operators import waiting as wt


def test_records_wake_when_their_last_object_arrives(spark):
    rng = random.Random(2)
    needs = {(g, f"r{k}"): {f"c{rng.randrange(12)}" for _ in range(rng.randrange(5))} for g in "gh" for k in range(30)}
    refs = spark.createDataFrame([(g, "m" + r, c) for (g, r), cs in needs.items() for c in cs], "group_id string, manifest_id string, content_id string")
    waiting = spark.createDataFrame([(g, r, "m" + r) for g, r in needs] + [("g", "r0", "mr0")], "group_id string, revision_id string, content_id string")
    have = {("g", "c1"), ("h", "c2")}
    objects = spark.createDataFrame([(g, c, (g, c) in have) for g in "gh" for c in ("c1", "c2", "c3")], "group_id string, content_id string, available boolean")
    lacks = {key: {c for c in cs if (key[0], c) not in have} for key, cs in needs.items()}
    done = {tuple(r) for r in wt.complete_already(waiting, refs, objects).collect()}
    assert done == {key for key, cs in lacks.items() if not cs}
    index = wt.waiting_index(waiting, refs, objects)
    for arrivals in ({("g", "c0"), ("h", "c3"), ("g", "nobody waits")}, {("g", f"c{k}") for k in range(9)}, {(g, f"c{k}") for g in "gh" for k in range(12)}):
        arrived = spark.createDataFrame([*arrivals, *arrivals], "group_id string, content_id string")
        complete, index = wt.wake(index, arrived)
        left = {key: cs - {c for g, c in arrivals if g == key[0]} for key, cs in lacks.items()}
        assert {tuple(r) for r in complete.collect()} == {key for key, cs in left.items() if not cs and lacks[key]}
        rows = {(r.group_id, r.revision_id, r.object_id, r.missing) for r in index.collect()}
        assert rows == {(*key, c, len(cs)) for key, cs in left.items() for c in cs}
        lacks = left
        index = spark.createDataFrame(index.collect(), index.schema)
    assert index.count() == 0


def test_one_catalog_for_all_groups(spark):
    refs = spark.createDataFrame([("m", "c"), ("m", "d")], "manifest_id string, content_id string")
    objects = spark.createDataFrame([("d", True)], "content_id string, available boolean")
    waiting = spark.createDataFrame([("g", "r", "m"), ("h", "s", "m")], "group_id string, revision_id string, content_id string")
    index = wt.waiting_index(waiting, refs, objects)
    assert {tuple(r) for r in index.collect()} == {("g", "r", "c", 1), ("h", "s", "c", 1)}
    complete, rest = wt.wake(index, refs.where(F.col("content_id") == "c").select("content_id"))
    assert {tuple(r) for r in complete.collect()} == {("g", "r"), ("h", "s")} and rest.count() == 0
