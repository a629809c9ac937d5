import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import transfers as tr

EVENT = "peer string, content_id string, event_id bigint, op string, request_id string, size bigint, start_offset bigint, len bigint"
KEYS = [(p, c) for p in "pq" for c in "xyz"]


def random_events(seed, count=700, cancels=0.2, completes=0.5):
    """Events that mostly fit the state they meet, so that transfers open, stall, fill and store."""
    rng = random.Random(seed)
    rows, opened = [], {}
    for i in range(count):
        key = rng.choices(KEYS, [12, 2, 1, 1, 1, 1])[0]
        op = rng.choices(["BEGIN", "APPEND", "COMPLETE", "CANCEL", "OTHER"], [1, 9, completes, cancels, 0.05])[0]
        if key not in opened and rng.random() < 0.5:
            op = "BEGIN"
        request = size = offset = length = None
        total, at = opened.get(key, (60, 0))
        if op == "BEGIN":
            request = rng.choice(["q", "q", "q", None, "0" * 32])
            size = rng.choice([60, 60, 400, 0, None, 1 << 40])
            if key not in opened and request == "q" and size in (60, 400):
                opened[key] = (size, 0)
        elif op == "APPEND":
            length = rng.choice([0, 1, 2, 3, 50, total - at])
            offset = rng.choice([at] * 4 + [0, rng.randrange(60)])
            if offset == at and at + length <= total:
                opened[key] = (total, at + length)
        elif op == "CANCEL":
            opened.pop(key, None)
        rows.append((*key, 3 * i, op, request, size, offset, length))
    return rows


def brute_force(rows, asked, have, opened):
    """(event_id -> (status, received), key -> (present, size, received)) by stepping through all events."""
    present, state, out = set(have), {k: (s, r) for k, s, r in opened}, {}
    requested = set(asked)
    for peer, content, at, op, request, size, offset, length in sorted(rows, key=lambda r: r[2]):
        key = (peer, content)
        now = state.get(key)
        if op == "BEGIN":
            if request in (None, "0" * 32):
                status = "NIL_REQUEST"
            elif size is None or not 1 <= size <= tr.MAXIMUM_SIZE:
                status = "SIZE_OUT_OF_RANGE"
            elif content in present:
                status = "ALREADY_PRESENT"
            elif key not in requested:
                status = "NOT_REQUESTED"
            elif now:
                status = "RESUME" if now[0] == size else "SIZE_MISMATCH"
            else:
                status, state[key] = "START", (size, 0)
        elif op == "APPEND":
            if not now:
                status = "NOT_FOUND"
            elif offset != now[1]:
                status = "OFFSET_MISMATCH"
            elif length == 0:
                status = "NOOP"
            elif now[1] + length > now[0]:
                status = "EXCEEDS_SIZE"
            else:
                status, state[key] = "ACCEPTED", (now[0], now[1] + length)
        elif op == "COMPLETE":
            status = "NOT_FOUND" if not now else "STORED" if now[0] == now[1] else "INCOMPLETE"
            if status == "STORED":
                present.add(content)
                state = {k: v for k, v in state.items() if k[1] != content}
        elif op == "CANCEL":
            status = "CANCELLED" if now else "NOTHING_TO_CANCEL"
            state.pop(key, None)
        else:
            status = "UNKNOWN_OPERATION"
        out[at] = (status, state.get(key, (None, None))[1])
    ends = {(r[0], r[1]): (r[1] in present, *state.get((r[0], r[1]), (None, None))) for r in rows}
    return out, ends


@pytest.mark.parametrize("seed, cancels, completes", [(1, 0.2, 0.5), (2, 0.0, 0.05), (3, 0.6, 0.02), (4, 0.05, 0.0)])
def test_long_transfers_replay_as_if_stepped_through(spark, seed, cancels, completes):
    rows = random_events(seed, 700, cancels, completes)
    asked, have = [k for k in KEYS if k != ("q", "z")], ["y"] if seed == 3 else []
    opened = [(("p", "x"), 61, 2), (("q", "y"), 5, 5)] if seed > 1 else []
    frames = (
        spark.createDataFrame(asked, "peer string, content_id string"),
        spark.createDataFrame([(c, True) for c in have], "content_id string, available boolean"),
        spark.createDataFrame([(*k, s, r) for k, s, r in opened], "peer string, content_id string, size bigint, received bigint"),
    )
    want, ends = brute_force(rows, asked, have, opened)
    assert seed > 2 or any(s == "STORED" for s, _ in want.values())
    for segment_rows in (16, None):
        fold = tr.replay_transfers(spark.createDataFrame(rows, EVENT), *frames, segment_rows=segment_rows)
        assert {r.event_id: (r.status, r.received) for r in fold.outcomes.collect()} == want
        got = {(r.peer, r.content_id): (r.state.present, r.state.size, r.state.received) for r in fold.states.collect()}
        assert got == ends


def test_rounds_are_logarithmic(spark):
    n = 4000  # one chain: every append takes the offset the one before left
    rows = [("p", "x", 0, "BEGIN", "q", 10 * n, None, None)]
    rows += [("p", "x", i + 1, "APPEND", None, None, i, 1) for i in range(n)]
    segments = 40
    cut = spark.createDataFrame([(*r, r[2] * segments // (n + 1)) for r in rows], EVENT + ", _segment bigint")
    state = F.expr("named_struct('open', false, 'size', null, 'received', null, 'present', false, 'requested', true, 'stored_at', null)")
    init = spark.createDataFrame([("p", "x")], "peer string, content_id string").withColumn("state", state.cast(tr.STATE_TYPE))
    starts, rounds = tr.segment_starts(cut, init)
    got = {r._segment: r.state.received for r in starts.collect()}
    first = {k: min(r[2] for r in rows if r[2] * segments // (n + 1) == k) for k in range(1, segments)}
    assert [got[k] for k in range(1, segments)] == [first[k] - 1 for k in range(1, segments)]
    assert rounds <= math.log2(n) + 2


def test_outcomes_and_states_of_one_pass(spark):
    """What both are read from is written, so neither folds the rows again."""
    rows = random_events(1)
    frames = [
        spark.createDataFrame(rows, EVENT),
        spark.createDataFrame(KEYS, "peer string, content_id string"),
        spark.createDataFrame([], "content_id string, available boolean"),
    ]
    want, ends = brute_force(rows, KEYS, [], [])
    for segment_rows in (16, None):
        fold = tr.replay_transfers(*frames, segment_rows=segment_rows, once=True)
        assert {r.event_id: (r.status, r.received) for r in fold.outcomes.collect()} == want
        got = {(r.peer, r.content_id): (r.state.present, r.state.size, r.state.received) for r in fold.states.collect()}
        assert got == ends
        for frame in (fold.outcomes, fold.states):
            assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()
