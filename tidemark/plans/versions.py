"""Queries over version vectors and reconciliation, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vv
from tidemark.operators import reconcile as rc
from tidemark.operators.ranking import previous_row
from tidemark.plans import fixtures as fx
from tidemark.plans import sql
from tidemark.session import materialized, step_folder

WITH_CHANGES = f"WITH {sql.CHANGES}"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change with the record before it on the same path."""
    return previous_row(fx.changes(spark, sf_dir), ["path_id"], "sequence", rc.RECORD)


def hurt_entries() -> F.Column:
    """Vectors with one rule broken in some rows, unsorted in others."""
    rid = F.col("sequence")
    zero = F.array(vv.vv_entry(F.lit("zz"), F.lit(0)))
    return (
        F.when(rid % 11 == 0, F.concat("vv", F.slice("vv", 1, 1)))
        .when(rid % 13 == 0, F.concat("vv", zero))
        .when(rid % 17 == 0, F.reverse("vv"))
        .when(rid % 19 == 0, F.slice("vv", 1, 0))
        .otherwise(F.col("vv"))
    )


HURT_SQL = """hurt AS (
  SELECT sequence, CASE WHEN sequence % 11 = 0 THEN vv || vv[1:1]
                        WHEN sequence % 13 = 0 THEN vv || [struct_pack(d := 'zz', c := CAST(0 AS BIGINT))]
                        WHEN sequence % 17 = 0 THEN list_reverse(vv)
                        WHEN sequence % 19 = 0 THEN vv[1:0] ELSE vv END AS entries
  FROM changes)"""


def vv_validate(spark, sf_dir):
    rows = fx.changes(spark, sf_dir).select("sequence", hurt_entries().alias("entries"))
    entries = F.col("entries")
    return rows.select(
        "sequence",
        vv.vv_error(entries).alias("error"),
        vv.vv_error(entries, manifest=True).alias("record_error"),
        vv.vv_text(vv.vv_from_entries(entries)).alias("canonical"),
    )


_DEVICES = "list_transform(entries, lambda x: x.d)"
_ZERO = "len(list_filter(entries, lambda x: x.c = 0)) > 0"
_REPEATED = f"len(list_distinct({_DEVICES})) < len(entries)"
VV_VALIDATE = f"""{WITH_CHANGES}, {HURT_SQL}
SELECT sequence,
       CASE WHEN {_ZERO} THEN 'ZERO_COUNTER' WHEN {_REPEATED} THEN 'DUPLICATE_DEVICE' END AS error,
       CASE WHEN len(entries) = 0 THEN 'EMPTY'
            WHEN {_DEVICES} <> list_sort(list_distinct({_DEVICES})) THEN 'NOT_STRICTLY_SORTED'
            WHEN {_ZERO} THEN 'ZERO_COUNTER' END AS record_error,
       CASE WHEN NOT ({_ZERO}) AND NOT ({_REPEATED}) THEN {sql.text("list_sort(entries)")} END AS canonical
FROM hurt"""


def vv_counters(spark, sf_dir):
    rows = fx.changes(spark, sf_dir)
    return rows.select(
        "sequence",
        vv.vv_counter(F.col("vv"), F.lit("view")).alias("view_counter"),
        vv.vv_text(vv.vv_increment(F.col("vv"), F.lit("newcomer"))).alias("joined"),
        vv.vv_text(vv.vv_increment(F.col("vv"), F.col("author"))).alias("edited"),
    )


VV_COUNTERS = f"""{WITH_CHANGES}
SELECT sequence, coalesce(list_filter(vv, lambda x: x.d = 'view')[1].c, 0) AS view_counter,
       {sql.text("list_sort(vv || [struct_pack(d := 'newcomer', c := CAST(1 AS BIGINT))])")} AS joined,
       array_to_string(list_transform(vv, lambda x: x.d || ':' ||
         CAST(x.c + CASE WHEN x.d = author THEN 1 ELSE 0 END AS VARCHAR)), ',') AS edited
FROM changes"""


def vv_merge_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).where("previous IS NOT NULL").select(
        "sequence", vv.vv_text(vv.vv_merge(F.col("previous.vv"), F.col("vv"))).alias("merged")
    )


VV_MERGE_PAIRS = f"""{WITH_CHANGES}, sides AS (
  SELECT p.sequence, x.d, x.c FROM paired p, unnest(p.vv) AS t(x) WHERE l_rev IS NOT NULL
  UNION ALL SELECT p.sequence, x.d, x.c FROM paired p, unnest(p.l_vv) AS t(x)),
tops AS (SELECT sequence, d, max(c) AS c FROM sides GROUP BY sequence, d)
SELECT sequence, string_agg(d || ':' || c, ',' ORDER BY d) AS merged FROM tops GROUP BY sequence"""


def vv_merge_by_file(spark, sf_dir):
    merged = vv.vv_merge_agg(fx.changes(spark, sf_dir), ["file_id"])
    return merged.select("file_id", vv.vv_text(F.col("vv")).alias("merged"))


VV_MERGE_BY_FILE = f"""{WITH_CHANGES}, tops AS (
  SELECT path_id, d, max(c) AS c FROM entries JOIN e USING (sequence) GROUP BY path_id, d)
SELECT path_id AS file_id, string_agg(d || ':' || c, ',' ORDER BY d) AS merged FROM tops GROUP BY path_id"""


def vv_relations(spark, sf_dir):
    prev = F.col("previous.vv")
    return pairs(spark, sf_dir).where("previous IS NOT NULL").select(
        "sequence",
        vv.vv_relation(prev, F.col("vv")).alias("forward"),
        vv.vv_relation(F.col("vv"), prev).alias("backward"),
    )


VV_RELATIONS = f"""{WITH_CHANGES}
SELECT sequence, {sql.relation("l_vv", "vv")} AS forward, {sql.relation("vv", "l_vv")} AS backward
FROM paired WHERE l_rev IS NOT NULL"""


def vv_total_order(spark, sf_dir):
    return pairs(spark, sf_dir).where("previous IS NOT NULL").select(
        "sequence",
        vv.vv_ge(F.col("previous.vv"), F.col("previous.revision_id"), F.col("vv"), F.col("revision_id")).alias(
            "previous_wins"
        ),
    )


VV_TOTAL_ORDER = f"""{WITH_CHANGES}
SELECT sequence, (l_vv > vv OR (l_vv = vv AND l_rev >= revision_id)) AS previous_wins
FROM paired WHERE l_rev IS NOT NULL"""


def vv_labels(spark, sf_dir):
    return fx.changes(spark, sf_dir).select("sequence", vv.vv_label(F.col("vv")).alias("label"))


VV_LABELS = f"""{WITH_CHANGES}, ranked AS (
  SELECT sequence, d, row_number() OVER (PARTITION BY sequence ORDER BY c DESC, d DESC) AS rn FROM entries)
SELECT sequence, 'device-' || left(d, 8) AS label FROM ranked WHERE rn = 1"""


def decided(spark, sf_dir):
    d = rc.decide(F.col("previous"), rc.record())
    return pairs(spark, sf_dir).withColumn("d", d)


def reconcile_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy(F.col("d.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


_STEP = sql.decision("rel", "l_rev", "l_kind", "l_vv", "revision_id", "kind", "vv")
DECIDED_SQL = f"""{WITH_CHANGES}, related AS (SELECT *, {sql.relation("l_vv", "vv")} AS rel FROM paired),
decided AS (SELECT *, {_STEP["action"]} AS action, {_STEP["canonical"]} AS canonical_revision,
                   {_STEP["conflict"]} AS conflict_revision FROM related)"""
RECONCILE_COUNTS = f"{DECIDED_SQL} SELECT action, count(*) AS n FROM decided GROUP BY action"


def reconcile_consecutive(spark, sf_dir):
    return decided(spark, sf_dir).select("sequence", "path_id", "d.action", "d.canonical_revision", "d.conflict_revision")


RECONCILE_CONSECUTIVE = f"{DECIDED_SQL} SELECT sequence, path_id, action, canonical_revision, conflict_revision FROM decided"


def reconcile_heads(spark, sf_dir):
    """Other devices' records against my latest head; some records lack chunks."""
    log = fx.changes(spark, sf_dir)
    heads = rc.latest_heads(log.where(F.col("author") == fx.ME), ["path_id"])
    missing = log.where("sequence % 10 = 0").select("revision_id")
    out = rc.reconcile(heads, log, missing=missing)
    return out.select("sequence", "path_id", "action", "canonical_revision", "conflict_revision")


_HEAD = sql.decision("rel", "l_rev", "l_kind", "l_vv", "revision_id", "kind", "vv")
RECONCILE_HEADS = f"""{WITH_CHANGES}, heads AS (
  SELECT path_id, max_by(revision_id, sequence) AS l_rev, max_by(kind, sequence) AS l_kind,
         max_by(vv, sequence) AS l_vv, max(sequence) AS l_seq
  FROM changes WHERE author = '{fx.ME}' GROUP BY path_id),
joined AS (SELECT c.*, h.l_rev, h.l_kind, h.l_vv, h.l_seq, {sql.relation("h.l_vv", "c.vv")} AS rel
           FROM changes c LEFT JOIN heads h USING (path_id)),
decided AS (SELECT *, {_HEAD["action"]} AS act, {_HEAD["canonical"]} AS can, {_HEAD["conflict"]} AS con FROM joined),
final AS (SELECT *, CASE WHEN act IN ('USE_INCOMING', 'KEEP_BOTH') AND sequence % 10 = 0
                           OR act = 'KEEP_BOTH' AND l_seq % 10 = 0 THEN 'MISSING_OBJECTS' ELSE act END AS action
          FROM decided)
SELECT sequence, path_id, action, CASE WHEN action = 'KEEP_BOTH' THEN can END AS canonical_revision,
       CASE WHEN action = 'KEEP_BOTH' THEN con END AS conflict_revision FROM final"""


def folded(spark, sf_dir):
    log = fx.changes(spark, sf_dir)
    heads = rc.latest_heads(log.where(F.col("author") == fx.ME), ["path_id"])
    return rc.fold_heads(heads, log, fx.ME), log


def log_fold_heads(spark, sf_dir):
    fold, _ = folded(spark, sf_dir)
    return fold.states.select("path_id", "state.revision_id", "state.kind", vv.vv_text(F.col("state.vv")).alias("vv"))


def log_fold_outcomes(spark, sf_dir):
    return folded(spark, sf_dir)[0].outcomes


def log_fold_hot_path(spark, sf_dir):
    """Outcomes when all changes are of the same path, some of their chunks absent."""
    log = fx.one_path(spark, sf_dir)
    absent = log.where("sequence % 13 = 5").select("revision_id")
    return rc.fold_heads(log.where("false"), log, fx.ME, missing=absent).outcomes.select("sequence", "revision_id", "action")


# The first change decides the file; its changes in front of the head follow each other.
LOG_FOLD_HOT_PATH = """SELECT event_id + 1 AS sequence, lpad(CAST(event_id AS VARCHAR), 12, '0') AS revision_id,
       CASE WHEN event_id % 3 <> 0 THEN 'ERROR_DIFFERENT_FILES'
            WHEN event_id % 10 = 3 OR event_id % 4000 >= 2000 THEN 'KEEP_LOCAL'
            WHEN (event_id + 1) % 13 = 5 THEN 'MISSING_OBJECTS' ELSE 'USE_INCOMING' END AS action
FROM events"""
_FOLD = sql.decision("rel", "h_rev", "h_kind", "h_vv", "revision_id", "kind", "vv")
FOLD_SQL = f"""WITH RECURSIVE {sql.CHANGES}, foreign_changes AS (
  SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY sequence) AS rn FROM changes WHERE author <> '{fx.ME}'),
fold AS (
  SELECT p.path_id, CAST(0 AS BIGINT) AS rn, h.h_rev, h.h_kind, h.h_vv, CAST(NULL AS BIGINT) AS sequence,
         CAST(NULL AS VARCHAR) AS revision_id, CAST(NULL AS VARCHAR) AS action,
         CAST(NULL AS VARCHAR) AS canonical_revision, CAST(NULL AS VARCHAR) AS conflict_revision
  FROM (SELECT DISTINCT path_id FROM changes) p LEFT JOIN (
    SELECT path_id, max_by(revision_id, sequence) AS h_rev, max_by(kind, sequence) AS h_kind,
           max_by(vv, sequence) AS h_vv
    FROM changes WHERE author = '{fx.ME}' GROUP BY path_id) h USING (path_id)
  UNION ALL
  SELECT path_id, rn, CASE WHEN takes THEN revision_id ELSE h_rev END, CASE WHEN takes THEN kind ELSE h_kind END,
         CASE WHEN takes THEN vv ELSE h_vv END, sequence, revision_id, action, canonical, conflict
  FROM (SELECT *, action = 'USE_INCOMING' OR (action = 'KEEP_BOTH' AND canonical = revision_id) AS takes
        FROM (SELECT *, {_FOLD["action"]} AS action, {_FOLD["canonical"]} AS canonical, {_FOLD["conflict"]} AS conflict
              FROM (SELECT f.path_id, i.rn, f.h_rev, f.h_kind, f.h_vv, i.sequence, i.revision_id, i.kind, i.vv,
                           {sql.relation("f.h_vv", "i.vv")} AS rel
                    FROM fold f JOIN foreign_changes i ON i.path_id = f.path_id AND i.rn = f.rn + 1))))"""
LOG_FOLD_OUTCOMES = f"""{FOLD_SQL}
SELECT path_id, sequence, revision_id, action, canonical_revision, conflict_revision FROM fold WHERE rn > 0"""
LOG_FOLD_HEADS = f"""{FOLD_SQL}
SELECT path_id, h_rev AS revision_id, h_kind AS kind, {sql.text("h_vv")} AS vv
FROM fold QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY rn DESC) = 1 AND h_rev IS NOT NULL"""


def replay_report(spark, sf_dir):
    fold, log = folded(spark, sf_dir)
    unsigned = log.withColumn("author", F.when(F.col("sequence") % 50 != 0, F.col("author")))
    heads = rc.latest_heads(log.where(F.col("author") == fx.ME), ["path_id"])
    outcomes = rc.fold_heads(heads, unsigned, fx.ME).outcomes
    return rc.replay_report(outcomes, unsigned, fx.ME)


_UNSIGNED_FOLD = FOLD_SQL.replace(f"author <> '{fx.ME}'", f"author <> '{fx.ME}' AND sequence % 50 <> 0")
REPLAY_REPORT = f"""{_UNSIGNED_FOLD},
log AS (SELECT count(*) AS records_examined, count_if(sequence % 50 = 0) AS unsigned_records_skipped,
               count_if(author = '{fx.ME}' AND sequence % 50 <> 0) AS own_records FROM changes)
SELECT CAST(any_value(l.records_examined) AS BIGINT) AS records_examined,
       CAST(any_value(l.unsigned_records_skipped) AS BIGINT) AS unsigned_records_skipped,
       CAST(any_value(l.own_records) AS BIGINT) AS own_records,
       CAST(count_if(action = 'USE_INCOMING') AS BIGINT) AS records_applied,
       CAST(count_if(action = 'NO_CHANGE') AS BIGINT) AS records_unchanged,
       CAST(count_if(action = 'KEEP_LOCAL') AS BIGINT) AS records_kept_local,
       CAST(count_if(action = 'KEEP_BOTH') AS BIGINT) AS conflicts_kept_both, CAST(0 AS BIGINT) AS records_failed
FROM fold, log l"""


def causal_frontier(spark, sf_dir):
    return rc.frontier(fx.changes(spark, sf_dir)).drop("flag")


CAUSAL_FRONTIER = f"""{WITH_CHANGES}, dominated AS (
  SELECT a.sequence FROM changes a JOIN changes b ON a.file_id = b.file_id AND a.sequence <> b.sequence
  WHERE {sql.ahead("b.vv", "a.vv")} AND NOT {sql.ahead("a.vv", "b.vv")})
SELECT file_id, author, revision_id FROM changes WHERE sequence NOT IN (SELECT sequence FROM dominated)"""


FRONTIER_BATCHES = 10


def maintained_frontier(spark, sf_dir):
    """The frontier kept up through ten batches, which mix early and late records; each is given twice."""
    sequence = F.col("sequence")
    batches = materialized(irregular_changes(spark, sf_dir).withColumn("batch", sequence * 7 % FRONTIER_BATCHES))
    state = rc.frontier_table(spark, step_folder(spark, "frontier"), buckets=8)
    for batch in range(FRONTIER_BATCHES):
        for _ in range(2):
            rc.maintain_frontier(state, batches.where(F.col("batch") == batch), batch)
    return rc.kept_frontier(state)


def irregular_changes(spark, sf_dir):
    """The log with authors lost, records written twice and devices named twice."""
    seq, changes = F.col("sequence"), fx.changes(spark, sf_dir)
    lower = F.transform(F.slice("vv", 1, 1), lambda e: vv.vv_entry(e["d"], e["c"] - 1))
    changes = changes.withColumn("vv", F.when(seq % 11 == 4, F.concat("vv", lower)).otherwise(F.col("vv")))
    again = changes.where(seq % 7 == 3).withColumn("revision_id", F.concat("revision_id", F.lit("x")))
    lost = F.when(seq % 5 == 2, F.lit(None).cast("string")).otherwise(F.col("author"))
    return changes.unionByName(again).withColumn("author", lost)


def irregular_frontier(spark, sf_dir):
    return rc.frontier(irregular_changes(spark, sf_dir))


IRREGULAR_FRONTIER = f"""WITH f AS ({CAUSAL_FRONTIER}), kept AS (
  SELECT f.*, c.sequence FROM f JOIN (SELECT event_id + 1 AS sequence, lpad(CAST(event_id AS VARCHAR), 12, '0') AS revision_id
                                      FROM events) c USING (revision_id)),
written AS (SELECT * FROM kept
  UNION ALL SELECT file_id, author, revision_id || 'x', sequence FROM kept WHERE sequence % 7 = 3)
SELECT file_id, CASE WHEN sequence % 5 <> 2 THEN author END AS author, revision_id,
       CASE WHEN sequence % 5 = 2 THEN 'NO_AUTHOR' WHEN sequence % 7 = 3 THEN 'REPEATED_COUNTER' END AS flag FROM written"""


def unresolved_conflicts(spark, sf_dir):
    return rc.frontier_report(fx.changes(spark, sf_dir))


UNRESOLVED_CONFLICTS = f"""WITH f AS ({CAUSAL_FRONTIER})
SELECT file_id, count(*) AS heads, count(*) > 1 AS conflict FROM f GROUP BY file_id"""


def conflict_copies(spark, sf_dir):
    """Copies of the losing side of every consecutive conflict."""
    lost = decided(spark, sf_dir).where("d.action = 'KEEP_BOTH'").select(
        F.col("d.conflict_revision").alias("loser"),
        F.when(F.col("d.conflict_revision") == F.col("revision_id"), F.col("vv"))
        .otherwise(F.col("previous.vv"))
        .alias("vv"),
        "file_id",
    )
    named = lost.select(
        "file_id",
        F.col("loser").alias("revision_id"),
        "vv",
        F.concat(F.lit("docs/report-"), "file_id", F.lit(".final.txt")).alias("path"),
        (F.col("loser").cast("bigint") * 1000).alias("mtime_ms"),
    )
    return rc.conflict_copies(named, fx.KEY).select(
        "revision_id", "conflict_path", "conflict_file_id", "conflict_revision_id"
    )


def _derived(domain: str) -> str:
    digest = (
        f"sha256(concat('{fx.KEY}', '{domain}', chr(0), file_id, chr(0), revision_id, chr(0), conflict_path))"
    )
    return (
        f"concat({digest}[1:12], '5', {digest}[14:16], translate({digest}[17:17], '0123456789abcdef', "
        f"'89ab89ab89ab89ab'), {digest}[18:32])"
    )


CONFLICT_COPIES = f"""{DECIDED_SQL}, lost AS (
  SELECT file_id, conflict_revision AS revision_id,
         CASE WHEN conflict_revision = revision_id THEN vv ELSE l_vv END AS vv
  FROM decided WHERE action = 'KEEP_BOTH'),
named AS (
  SELECT DISTINCT file_id, revision_id, concat('docs/report-', file_id, '.final (conflict device-',
    left(list_sort(list_transform(vv, lambda x: struct_pack(c := x.c, d := x.d)))[-1].d, 8), ' ',
    CAST(CAST(revision_id AS BIGINT) * 1000 AS VARCHAR), ' ', left(revision_id, 8), ').txt') AS conflict_path
  FROM lost)
SELECT revision_id, conflict_path, {_derived("conflict-file")} AS conflict_file_id,
       {_derived("conflict-revision")} AS conflict_revision_id FROM named"""


def proposals(spark, sf_dir):
    """Changes as head proposals; every fourth expects an older head, some repeat one."""
    rows = previous_row(fx.changes(spark, sf_dir), ["path_id"], "sequence", ["content_id", "kind"])
    seq = F.col("sequence")
    return rows.select(
        "path_id",
        F.col("sequence").alias("position"),
        F.when(seq % 9 == 0, F.col("previous.content_id")).otherwise(F.col("content_id")).alias("content_id"),
        F.when(seq % 18 == 0, "FILE").otherwise(F.when(seq % 9 == 0, F.col("previous.kind")).otherwise(F.col("kind"))).alias("kind"),
        F.when(seq % 40 == 1, F.lit("elsewhere")).otherwise(F.col("previous.content_id")).alias("expected_previous"),
    ).where("content_id IS NOT NULL")


def cas_fold(spark, sf_dir):
    rows = proposals(spark, sf_dir)
    paths = fx.changes(spark, sf_dir).select("path_id").distinct()
    heads = paths.where("CAST(path_id AS INT) % 5 = 0").select(
        "path_id", F.lit("first").alias("content_id"), F.lit("FILE").alias("kind")
    )
    pending = paths.where("CAST(path_id AS INT) % 23 = 1").select("path_id", F.lit("other").alias("target_content_id"))
    return rc.cas_heads(heads, rows, pending)


def cas_statuses(spark, sf_dir):
    return cas_fold(spark, sf_dir).outcomes.select("path_id", "position", "content_id", "status")


def cas_final_heads(spark, sf_dir):
    return cas_fold(spark, sf_dir).states.select("path_id", "state.content_id", "state.kind")


CAS_SQL = f"""WITH RECURSIVE {sql.CHANGES}, stepped AS (
  SELECT path_id, sequence AS position, kind, content_id, lag(content_id) OVER w AS p_content, lag(kind) OVER w AS p_kind
  FROM changes WINDOW w AS (PARTITION BY path_id ORDER BY sequence)),
props AS (
  SELECT path_id, position, CASE WHEN position % 9 = 0 THEN p_content ELSE content_id END AS content_id,
         CASE WHEN position % 18 = 0 THEN 'FILE' WHEN position % 9 = 0 THEN p_kind ELSE kind END AS kind,
         CASE WHEN position % 40 = 1 THEN 'elsewhere' ELSE p_content END AS expected
  FROM stepped),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY position) AS rn FROM props
             WHERE content_id IS NOT NULL),
fold AS (
  SELECT DISTINCT path_id, CAST(0 AS BIGINT) AS rn,
         CASE WHEN CAST(path_id AS INT) % 5 = 0 THEN 'first' END AS h_content,
         CASE WHEN CAST(path_id AS INT) % 5 = 0 THEN 'FILE' END AS h_kind,
         CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS content_id, CAST(NULL AS VARCHAR) AS status
  FROM changes
  UNION ALL
  SELECT path_id, rn, CASE WHEN status = 'COMMITTED' THEN content_id ELSE h_content END,
         CASE WHEN status = 'COMMITTED' THEN kind ELSE h_kind END, position, content_id, status
  FROM (SELECT f.path_id, n.rn, f.h_content, f.h_kind, n.position, n.content_id, n.kind,
               CASE WHEN CAST(f.path_id AS INT) % 23 = 1 AND n.content_id <> 'other' THEN 'PENDING_OTHER_TARGET'
                    WHEN f.h_content = n.content_id AND f.h_kind = n.kind THEN 'IDEMPOTENT'
                    WHEN f.h_content = n.content_id THEN 'KIND_MISMATCH'
                    WHEN f.h_content IS DISTINCT FROM n.expected THEN 'STALE' ELSE 'COMMITTED' END AS status
        FROM fold f JOIN numbered n ON n.path_id = f.path_id AND n.rn = f.rn + 1))"""
CAS_STATUSES = f"{CAS_SQL} SELECT path_id, position, content_id, status FROM fold WHERE rn > 0"
CAS_FINAL_HEADS = f"""{CAS_SQL} SELECT path_id, h_content AS content_id, h_kind AS kind
FROM fold QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY rn DESC) = 1 AND h_content IS NOT NULL"""


def chained_proposals(spark, sf_dir):
    """All events as proposals for one head, each on the one before, with gaps and repeats."""
    seq = F.col("sequence")

    def named(back: int):
        return F.concat(F.lit("c"), (seq - back).cast("string"))

    return fx.changes(spark, sf_dir).select(
        F.lit("everything").alias("path_id"),
        seq.alias("position"),
        F.when(seq % 10 == 5, named(1)).otherwise(named(0)).alias("content_id"),
        "kind",
        F.when(seq == 1, F.lit(None).cast("string"))
        .when(seq % 40 == 21, F.lit("elsewhere"))
        .when((seq % 40 == 22) | (seq % 10 == 6), named(2))
        .otherwise(named(1))
        .alias("expected_previous"),
    )


def cas_hot_key(spark, sf_dir):
    """Statuses when every proposal is for the same head."""
    rows = chained_proposals(spark, sf_dir)
    none = rows.where("false")
    fold = rc.cas_heads(none, rows, none.select("path_id", F.col("content_id").alias("target_content_id")))
    return fold.outcomes.select("position", "content_id", "status")


CAS_HOT_KEY = f"""WITH RECURSIVE {sql.CHANGES}, props AS (
  SELECT sequence AS position, kind, CASE WHEN sequence % 10 = 5 THEN 'c' || (sequence - 1) ELSE 'c' || sequence END AS content_id,
         CASE WHEN sequence = 1 THEN NULL WHEN sequence % 40 = 21 THEN 'elsewhere'
              WHEN sequence % 40 = 22 OR sequence % 10 = 6 THEN 'c' || (sequence - 2)
              ELSE 'c' || (sequence - 1) END AS expected FROM changes),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY position) AS rn FROM props),
fold AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS h_content, CAST(NULL AS VARCHAR) AS h_kind,
         CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS content_id, CAST(NULL AS VARCHAR) AS status
  UNION ALL
  SELECT rn, CASE WHEN status = 'COMMITTED' THEN content_id ELSE h_content END,
         CASE WHEN status = 'COMMITTED' THEN kind ELSE h_kind END, position, content_id, status
  FROM (SELECT n.rn, f.h_content, f.h_kind, n.position, n.content_id, n.kind,
               CASE WHEN f.h_content = n.content_id AND f.h_kind = n.kind THEN 'IDEMPOTENT'
                    WHEN f.h_content = n.content_id THEN 'KIND_MISMATCH'
                    WHEN f.h_content IS DISTINCT FROM n.expected THEN 'STALE' ELSE 'COMMITTED' END AS status
        FROM fold f JOIN numbered n ON n.rn = f.rn + 1))
SELECT position, content_id, status FROM fold WHERE rn > 0"""


def latest_heads(spark, sf_dir):
    heads = rc.latest_heads(fx.changes(spark, sf_dir), ["path_id"])
    return heads.select("path_id", "sequence", "revision_id", "kind")


LATEST_HEADS = f"""{WITH_CHANGES}
SELECT path_id, sequence, revision_id, kind FROM changes
QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY sequence DESC) = 1"""


def live_files(spark, sf_dir):
    return rc.live_files(latest_heads(spark, sf_dir))


LIVE_FILES = f"SELECT * FROM ({LATEST_HEADS}) WHERE kind = 'FILE'"

QUERIES = {
    "vv_validate": (vv_validate, VV_VALIDATE),
    "vv_counters": (vv_counters, VV_COUNTERS),
    "vv_merge_pairs": (vv_merge_pairs, VV_MERGE_PAIRS),
    "vv_merge_by_file": (vv_merge_by_file, VV_MERGE_BY_FILE),
    "vv_relations": (vv_relations, VV_RELATIONS),
    "vv_total_order": (vv_total_order, VV_TOTAL_ORDER),
    "vv_labels": (vv_labels, VV_LABELS),
    "reconcile_counts": (reconcile_counts, RECONCILE_COUNTS),
    "reconcile_consecutive": (reconcile_consecutive, RECONCILE_CONSECUTIVE),
    "reconcile_heads": (reconcile_heads, RECONCILE_HEADS),
    "log_fold_heads": (log_fold_heads, LOG_FOLD_HEADS),
    "log_fold_outcomes": (log_fold_outcomes, LOG_FOLD_OUTCOMES),
    "log_fold_hot_path": (log_fold_hot_path, LOG_FOLD_HOT_PATH),
    "replay_report": (replay_report, REPLAY_REPORT),
    "causal_frontier": (causal_frontier, CAUSAL_FRONTIER),
    "irregular_frontier": (irregular_frontier, IRREGULAR_FRONTIER),
    "maintained_frontier": (maintained_frontier, IRREGULAR_FRONTIER),
    "unresolved_conflicts": (unresolved_conflicts, UNRESOLVED_CONFLICTS),
    "conflict_copies": (conflict_copies, CONFLICT_COPIES),
    "cas_statuses": (cas_statuses, CAS_STATUSES),
    "cas_final_heads": (cas_final_heads, CAS_FINAL_HEADS),
    "cas_hot_key": (cas_hot_key, CAS_HOT_KEY),
    "latest_heads": (latest_heads, LATEST_HEADS),
    "live_files": (live_files, LIVE_FILES),
}
