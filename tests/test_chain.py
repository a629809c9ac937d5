import random

from pyspark.sql import functions as F

from tidemark.operators import chain, transfers


def test_paths_of_ranges_are_those_of_single_steps(spark):
    rng = random.Random(12)
    rows, starts, want = [], [], set()
    for key in ("a", None, "b", *(f"k{i}" for i in range(40))):
        n = 300 if key in ("a", None) else rng.randint(1, 12)
        at = sorted(rng.sample(range(-5, 5000), n))
        follow = {a: rng.choice([*at[i + 1 : i + 6], None]) if rng.random() < 0.97 else None for i, a in enumerate(at)}
        rows += [(key, a, t) for a, t in follow.items()]
        for step in [at[0], *rng.sample(at, 1)]:
            starts.append((key, step))
            while step is not None:
                want.add((key, step))
                step = follow[step]
    pointers = spark.createDataFrame(rows, "k string, at bigint, to bigint")
    begun = spark.createDataFrame(starts, "k string, at bigint")
    for size in (7, 64, None):
        reached, _ = chain.reachable_forward(pointers, begun, ["k"], size)
        got = [(r.k, r.at) for r in reached.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rounds_follow_the_ranges_and_not_the_chain(spark):
    rows = [("p", k, f"c{k}", f"c{k - 1}" if k else None) for k in range(600)]
    proposals = spark.createDataFrame(rows, "path_id string, position bigint, content_id string, expected_previous string")
    heads = spark.createDataFrame([], "path_id string, content_id string")
    committed, rounds = chain.committed_rows(proposals, heads, ["path_id"], "position", F.lit(False))
    assert committed.count() == 600 and rounds <= 1


def test_long_keys_are_folded_by_all_tasks_of_the_session(spark):
    rows = [("p", "x", 0, "BEGIN", "q", 400, None, None)] + [("p", "x", i + 1, "APPEND", None, None, i, 1) for i in range(400)]
    event = "peer string, content_id string, event_id bigint, op string, request_id string, size bigint, start_offset bigint, len bigint"
    events = spark.createDataFrame(rows, event)
    none = events.where("false").select("content_id", F.lit(True).alias("available"))
    fold = transfers.replay_transfers(events, events.select("peer", "content_id").distinct(), none, segment_rows=16)
    assert "REPARTITION_BY_NUM" in fold.outcomes._jdf.queryExecution().executedPlan().toString()
    got = {r.event_id: (r.status, r.received) for r in fold.outcomes.collect()}
    assert got == {0: ("START", 0), **{i + 1: ("ACCEPTED", i + 1) for i in range(400)}}
