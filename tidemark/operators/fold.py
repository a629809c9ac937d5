"""Ordered folds per key, for rules that depend on the order of arrival.

Such a fold cannot be a commutative aggregate. Every key is cut into segments of bounded size
which are folded side by side; most keys have one, and those are folded in one pass without
anything else. For a key of several segments the state each one starts from has to be known:

* a rule set with a closed form for it passes ``starts``;
* otherwise ``entries`` lists states a segment may hand on. All segments are folded from all
  candidates of the segment before, side by side, and a key's true states are followed through these
  results by pointer doubling. Where a state is met that was no candidate, that state is folded through
  the next segments, twice as many each time it passes through all of them unchanged.

Candidates only save rounds: what is found is always the state the sequential fold has.

Rows of a long key that no state is moved by (``apart``) are taken out before it is cut: they would
only push the rows that matter out of the candidates' sight.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import let
from tidemark.operators.chain import reachable
from tidemark.operators.ranking import join_on_keys, rows_before
from tidemark.session import discard, materialized

SEGMENT_ROWS = 2048

#: Candidate states of a segment's end; others cost a round of their own.
CANDIDATES = 16
#: Segments that such a state is folded through at first.
WIDTH = 8
#: Outcomes gathered in one list before that list is kept as a whole.
TRACE_ROWS = 64

Transition = Callable[[Column, Column], Column]
#: (rows of a segment) -> array of states it may end in
Entries = Callable[[Column], Column]


# (rows of keys with several segments: keys, order, fields, ``_segment``; init) -> keys, _segment, state
Starts = Callable[[DataFrame, DataFrame], DataFrame]
# (rows of keys with several segments, init) -> the rows with ``_idle``: a state (NULL: the row has to be folded)
# from which the row has the outcome it has from any state that can reach it, and which it leaves as it is
Apart = Callable[[DataFrame, DataFrame], DataFrame]


class Fold:
    """``outcomes``: one row per input row. ``states``: the last state per key.

    Either is planned when it is first asked for. ``written``: tables both read, which may be discarded after use.
    """

    def __init__(self, outcomes: Callable[[], DataFrame], states: Callable[[], DataFrame], written: tuple[DataFrame, ...] = ()):
        self._outcomes, self._states, self.written = outcomes, states, written

    @cached_property
    def outcomes(self) -> DataFrame:
        return self._outcomes()

    @cached_property
    def states(self) -> DataFrame:
        return self._states()


def segmented_fold(
    rows: DataFrame,
    keys: list[str],
    order: str,
    fields: list[str],
    init: DataFrame,
    state_type: str,
    outcome_type: str,
    transition: Transition,
    segment_rows: int | None = None,
    starts: Starts | None = None,
    entries: Entries | None = None,
    apart: Apart | None = None,
    once: bool = False,
) -> Fold:
    """Fold ``rows`` of each key in ``order``.

    ``init`` holds ``keys`` and a ``state`` column; a key without a row starts from NULL.
    ``transition(state, row)`` is a deterministic column of the next ``state`` and the
    ``outcome`` to emit for the row; both are structs of the named types. ``once`` is for callers that need outcomes
    and states: rows are folded now, and what comes of each segment is written.
    """
    size = segment_rows or SEGMENT_ROWS
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *fields)))
    init = init.select(*keys, F.col("state").cast(state_type).alias("state"))
    if starts is None:

        def starts(cut: DataFrame, first: DataFrame) -> DataFrame:
            segments = materialized(cut.groupBy(*keys, "_segment").agg(packed.alias("rows")))
            return settle(segments, keys, first, state_type, transition, entries)[0]

    batches, idle = _batches(rows, keys, order, fields, size, packed, init, starts, apart)

    # A row's outcome enters the trace one step later: what a step computes stays small (Spark
    # copies it). Appending copies a trace, so one is gathered per TRACE_ROWS rows.
    step_type = f"struct<state:{state_type},outcome:{outcome_type}>"
    trace_type = f"array<struct<_order:bigint,outcome:{outcome_type}>>"

    def entering(state: Column) -> Column:
        return F.struct(
            F.struct(state.alias("state"), F.lit(None).cast(outcome_type).alias("outcome")).cast(step_type).alias("step"),
            F.lit(None).cast("bigint").alias("_order"),
            F.array().cast(trace_type).alias("trace"),
        )

    def traced(acc: Column) -> Column:
        entry = F.struct(acc["_order"].alias("_order"), acc["step"]["outcome"].alias("outcome"))
        met = F.when(acc["_order"].isNotNull(), F.array(entry)).otherwise(F.array())
        return F.concat(acc["trace"], met.cast(trace_type))

    def advance(acc: Column, row: Column) -> Column:
        return F.struct(
            transition(acc["step"]["state"], row).cast(step_type).alias("step"),
            row["_order"].cast("bigint").alias("_order"),
            traced(acc).alias("trace"),
        )

    def finished(acc: Column) -> Column:
        return F.struct(acc["step"]["state"].alias("state"), traced(acc).alias("trace"))

    whole_type = f"struct<state:{state_type},traces:array<{trace_type}>>"

    def advance_part(acc: Column, first: Column) -> Column:
        part = F.aggregate(F.slice("rows", first, TRACE_ROWS), entering(acc["state"]), advance, finished)
        return let(
            part,
            lambda p: F.struct(
                p["state"].alias("state"), F.concat(acc["traces"], F.array(p["trace"])).alias("traces")
            ).cast(whole_type),
        )

    begin = F.struct("state", F.array().cast(f"array<{trace_type}>").alias("traces")).cast(whole_type)
    parts = F.sequence(F.lit(1), F.size("rows"), F.lit(TRACE_ROWS))
    # One column for both, as Spark would fold the rows for each.
    once_folded = materialized(batches.select(*keys, "_segment", F.aggregate(parts, begin, advance_part).alias("_whole"))) if once else None

    def outcomes() -> DataFrame:
        if once_folded is None:
            traced_rows, trace = batches, F.aggregate(parts, begin, advance_part, lambda acc: F.flatten(acc["traces"]))
        else:
            traced_rows, trace = once_folded, F.flatten("_whole.traces")
        folded = traced_rows.select(*keys, F.explode(trace).alias("_t")).select(
            *keys, F.col("_t._order").alias(order), "_t.outcome.*"
        )
        if idle is None:
            return folded
        same = idle.select(*keys, order, transition(F.col("_idle"), F.struct(*fields))["outcome"].cast(outcome_type).alias("_o"))
        return folded.unionByName(same.select(*keys, order, "_o.*"))

    def states() -> DataFrame:
        ended = (
            batches.select(*keys, "_segment", _exit(transition, state_type).alias("state"))
            if once_folded is None
            else once_folded.select(*keys, "_segment", F.col("_whole.state").alias("state"))
        )
        last = ended.groupBy(*keys).agg(F.max_by("state", "_segment").alias("state"))
        if idle is not None:
            # A key whose rows are all idle has no segment and keeps its first state.
            kept = init.withColumnRenamed("state", "_first").join(last, keys, "full_outer")
            last = kept.select(*keys, F.coalesce("state", "_first").alias("state"))
        else:
            last = last.unionByName(init.join(rows.select(*keys).distinct(), keys, "left_anti"))
        return last.where(F.col("state").isNotNull())

    return Fold(outcomes, states, () if once_folded is None else (once_folded,))


def _exit(transition: Transition, state_type: str) -> Column:
    return F.aggregate("rows", F.col("state"), lambda s, r: transition(s, r)["state"].cast(state_type))


def _batches(rows, keys, order, fields, size, packed, init, starts, apart) -> tuple[DataFrame, DataFrame | None]:
    """Segments with the true state each one starts from, and the rows that were set apart (None: no key is long)."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Most tables have none or few; their rows alone are cut and kept.
    split = materialized(counts.where(F.col("_n") > 2 * size).select(*keys))
    first = F.lit(0).cast("bigint")
    if split.isEmpty():
        whole = rows.groupBy(*keys).agg(packed.alias("rows"))
        return whole.join(init, keys, "left").select(*keys, first.alias("_segment"), "rows", "state"), None
    single = rows.join(split, keys, "left_anti").groupBy(*keys).agg(packed.alias("rows"))
    single = single.join(init, keys, "left").select(*keys, first.alias("_segment"), "rows", "state")
    mine = init.join(split, keys, "left_semi")
    long, idle = rows.join(split, keys, "left_semi").select(*keys, order, *fields), None
    if apart is not None:
        told = materialized(apart(long, mine))
        long, idle = told.where(F.col("_idle").isNull()).drop("_idle"), told.where(F.col("_idle").isNotNull())
    celled = long.withColumn("_cell", F.expr(f"`{order}` div {size}"))
    cut = join_on_keys(celled, segment_cells(celled, keys, size), [*keys, "_cell"]).drop("_cell")
    cut = materialized(cut.select(*keys, order, *fields, "_segment"))
    at = [*keys, "_segment"]
    segments = cut.groupBy(*at).agg(packed.alias("rows"))
    begun = join_on_keys(segments, starts(cut, mine).select(*at, "state"), at)
    # Folding a segment costs far more than its bytes tell, so tasks are not merged by bytes.
    return single.unionByName(begun.repartition(_tasks(begun), *at)), idle


def _tasks(df: DataFrame) -> int:
    """Tasks of the session, so that every core has segments to fold."""
    session = df.sparkSession
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def segment_cells(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, cell) -> segment.

    ``order`` is unique in the key and not negative, so a cell of ``size`` consecutive values
    holds at most ``size`` rows and a segment at most twice that.
    """
    cells = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("n"))
    return rows_before(cells, keys, "_cell").select(
        *keys, "_cell", F.expr(f"before div {size}").alias("_segment")
    )


def settle(
    segments: DataFrame,
    keys: list[str],
    init: DataFrame,
    state_type: str,
    transition: Transition,
    entries: Entries | None = None,
) -> tuple[DataFrame, int]:
    """(keys, ``_segment``, ``state``): the true state each segment starts from, and the rounds it took.

    ``segments``: keys, ``_segment`` (from 0, without gaps), ``rows``.
    """
    at = [*keys, "_segment"]
    exit_state = _exit(transition, state_type)
    none = F.lit(None).cast(state_type)
    first = segments.where("_segment = 0").select(*keys, F.lit(0).cast("bigint").alias("_segment"))
    front = materialized(first.join(init, keys, "left").select(*at, "state", F.lit(WIDTH).alias("_width")))
    ends = materialized(segments.groupBy(*keys).agg(F.max("_segment").alias("_last")))

    # Every segment is folded from what the one before may hand on.
    guess = F.aggregate("rows", none, lambda s, r: transition(s, r)["state"].cast(state_type))
    handed = F.array(guess) if entries is None else F.concat(F.array(guess), entries(F.col("rows")))
    candidates = segments.select(
        *keys,
        (F.col("_segment") + 1).alias("_segment"),
        F.explode(F.slice(F.array_distinct(handed), 1, CANDIDATES)).alias("state"),
    )
    node, onward = F.struct("_segment", "state"), F.struct((F.col("_segment") + 1).alias("_segment"), F.col("_exit").alias("state"))
    known = join_on_keys(segments, candidates, at).select(*at, "state", exit_state.alias("_exit"))
    known = materialized(known.select(*keys, node.alias("at"), onward.alias("to")))

    settled, rounds = [], 0
    while True:
        rounds += 1
        starts = front.select(*keys, F.struct("_segment", "state").alias("at"))
        found = reachable(known, starts, keys)[0]
        path = join_on_keys(found, ends, keys).select(*keys, "at.*", "_last")
        path = materialized(path.where(F.col("_segment") <= F.col("_last")).distinct())
        settled.append(path.select(*at, "state"))
        widths = front.select(*keys, "_width")
        top = path.groupBy(*keys).agg(
            F.max_by(F.struct("_segment", "state"), "_segment").alias("_front"), F.max("_last").alias("_last")
        )
        top = materialized(join_on_keys(top, widths, keys).where(F.col("_front._segment") < F.col("_last")))
        discard(found, front)
        if top.isEmpty():
            break
        # No candidate: fold this state through the next segments as long as it stays the same.
        window = materialized(
            join_on_keys(segments, top, keys)
            .where(F.col("_segment").between(F.col("_front._segment"), F.col("_front._segment") + F.col("_width") - 1))
            .select(*at, F.col("_front.state").alias("state"), "_width", "_last", "rows")
            .select(*at, "state", "_width", "_last", exit_state.alias("_exit"))
        )
        same = F.col("_exit").eqNullSafe(F.col("state"))
        stop = window.groupBy(*keys).agg(
            F.coalesce(F.min(F.when(~same, F.col("_segment"))), F.max("_segment")).alias("_stop"),
            F.min(same).alias("_all"),
        )
        passed = materialized(join_on_keys(window, stop, keys).where(F.col("_segment") <= F.col("_stop")))
        discard(window, top)
        settled.append(passed.select(*at, "state"))
        front = passed.where(F.col("_segment") == F.col("_stop")).select(
            *keys,
            (F.col("_segment") + 1).alias("_segment"),
            F.col("_exit").alias("state"),
            F.when(F.col("_all"), F.col("_width") * 2).otherwise(WIDTH).alias("_width"),
            "_last",
        )
        front = materialized(front.where(F.col("_segment") <= F.col("_last")).drop("_last"))
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, settled).distinct(), rounds
