"""Queries over the change log, admission, requests, transfers and upkeep, with SQL checks."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import admission, changelog, exchange as ex, members as mb, reports, requests as rq, retention as rt
from tidemark.operators import transfers as tr
from tidemark.operators import waiting as wt
from tidemark.operators.manifests import missing_objects
from tidemark.plans import fixtures as fx
from tidemark.plans import sql, versions
from tidemark.session import materialized, step_folder
from tidemark.sources import tables
from tidemark.sources.keyed import KeyedTable
from tidemark.streaming import pull as pl
from tidemark.streaming import transfers as ts

NOW = 1_700_000_000_000
LONG = "bigint"


def text(prefix: str, column) -> F.Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix), column.cast("string"))


# --- change log ----------------------------------------------------------------------------


def order_changes(spark, sf_dir):
    """Orders as changes of one group, in order of their keys."""
    key = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(
        F.lit(1).cast(LONG).alias("group_id"),
        text("r", key).alias("revision_id"),
        text("m", key).alias("content_id"),
        F.col("o_custkey").alias("author"),
        key.alias("k"),
    )


def order_log(spark, sf_dir):
    """The part of the orders that is in the log already, some under another content."""
    content = F.when(F.col("k") % 9 == 0, "other").otherwise(F.col("content_id"))
    return order_changes(spark, sf_dir).where("k % 3 = 0").select(
        "group_id", "revision_id", content.alias("content_id"), (F.col("k") + 1).alias("sequence")
    )


def order_refs(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select(
        text("m", "l_orderkey").alias("manifest_id"), text("p", "l_partkey").alias("content_id")
    )


def order_objects(spark, sf_dir):
    """Manifests of orders and chunks of parts; some absent, some of the wrong kind."""
    key = F.col("o_orderkey")
    manifests = fx.table(spark, sf_dir, "orders").where("o_orderkey % 29 <> 1").select(
        text("m", key).alias("content_id"),
        F.when(key % 31 == 2, "CHUNK").otherwise("MANIFEST").alias("kind"),
        F.lit(True).alias("available"),
    )
    part = F.col("p_partkey")
    chunks = fx.table(spark, sf_dir, "part").select(
        text("p", part).alias("content_id"),
        F.when(part % 97 == 3, "MANIFEST").otherwise("CHUNK").alias("kind"),
        (part % 40 != 5).alias("available"),
    )
    return manifests.unionByName(chunks)


ORDERS_SQL = """order_changes AS (
  SELECT 1 AS group_id, 'r' || o_orderkey AS revision_id, 'm' || o_orderkey AS content_id,
         o_custkey AS author, o_orderkey AS k FROM orders),
order_log AS (
  SELECT group_id, revision_id, CASE WHEN k % 9 = 0 THEN 'other' ELSE content_id END AS content_id, k + 1 AS sequence
  FROM order_changes WHERE k % 3 = 0),
order_refs AS (SELECT 'm' || l_orderkey AS manifest_id, 'p' || l_partkey AS content_id FROM lineitem),
order_objects AS (
  SELECT 'm' || o_orderkey AS content_id, CASE WHEN o_orderkey % 31 = 2 THEN 'CHUNK' ELSE 'MANIFEST' END AS kind,
         true AS available FROM orders WHERE o_orderkey % 29 <> 1
  UNION ALL
  SELECT 'p' || p_partkey, CASE WHEN p_partkey % 97 = 3 THEN 'MANIFEST' ELSE 'CHUNK' END, p_partkey % 40 <> 5 FROM part),
ready AS (SELECT * FROM order_objects WHERE available),
chunk_problems AS (
  SELECT manifest_id, CASE WHEN o.kind IS NULL THEN 'OBJECT_NOT_FOUND' ELSE 'OBJECT_KIND_MISMATCH' END AS p, r.content_id
  FROM order_refs r LEFT JOIN ready o USING (content_id) WHERE o.kind IS NULL OR o.kind <> 'CHUNK'),
problems AS (
  SELECT c.content_id, coalesce(
      CASE WHEN o.kind IS NULL THEN 'OBJECT_NOT_FOUND' WHEN o.kind <> 'MANIFEST' THEN 'OBJECT_KIND_MISMATCH' END,
      (SELECT min_by(p, q.content_id) FROM chunk_problems q WHERE q.manifest_id = c.content_id)) AS problem
  FROM (SELECT DISTINCT content_id FROM order_changes UNION SELECT 'other') c LEFT JOIN ready o USING (content_id))"""


def append_batch(spark, sf_dir):
    """All orders as one batch, with repeats; some repeats name another content."""
    once = order_changes(spark, sf_dir).withColumn("arrival", F.col("k"))
    again = once.where("k % 10 = 4").withColumn("arrival", F.col("k") + 1_000_000_000)
    other = once.where("k % 25 = 7").withColumn("arrival", F.col("k") + 2_000_000_000).withColumn(
        "content_id", text("m", F.col("k") + 1)
    )
    rows = once.unionByName(again).unionByName(other)
    return rows.select("group_id", "revision_id", "content_id", "arrival")


def append_statuses(spark, sf_dir):
    return changelog.append_changes(
        order_log(spark, sf_dir), append_batch(spark, sf_dir), order_refs(spark, sf_dir), order_objects(spark, sf_dir)
    )


def append_indexed(spark, sf_dir):
    """The same batch, appended to a log that is stored in buckets."""
    log = changelog.create_log(order_log(spark, sf_dir), step_folder(spark, "log"))
    return changelog.append_to_log(log, append_batch(spark, sf_dir), order_refs(spark, sf_dir), order_objects(spark, sf_dir))


APPEND_STATUSES = f"""WITH {ORDERS_SQL}, batch AS (
  SELECT group_id, revision_id, content_id, k AS arrival FROM order_changes
  UNION ALL SELECT group_id, revision_id, content_id, k + 1000000000 FROM order_changes WHERE k % 10 = 4
  UNION ALL SELECT group_id, revision_id, 'm' || (k + 1), k + 2000000000 FROM order_changes WHERE k % 25 = 7),
tops AS (SELECT coalesce(max(sequence), 0) AS top FROM order_log),
judged AS (
  SELECT b.*, l.content_id AS old_content, l.sequence AS old_sequence,
         CASE WHEN p.content_id IS NULL THEN 'OBJECT_NOT_FOUND' ELSE p.problem END AS problem
  FROM batch b LEFT JOIN order_log l USING (revision_id) LEFT JOIN problems p ON p.content_id = b.content_id),
firsts AS (
  SELECT revision_id, min(arrival) AS first_arrival, min_by(content_id, arrival) AS first_content,
         row_number() OVER (ORDER BY min(arrival)) AS rank
  FROM judged WHERE old_content IS NULL AND problem IS NULL GROUP BY revision_id),
final AS (
  SELECT j.*, f.rank, CASE
    WHEN old_content IS NOT NULL THEN CASE WHEN old_content = content_id THEN 'REPLAYED' ELSE 'REVISION_CONTENT_MISMATCH' END
    WHEN arrival = first_arrival THEN 'COMMITTED'
    WHEN arrival > first_arrival AND first_content = content_id THEN 'REPLAYED'
    WHEN arrival > first_arrival THEN 'REVISION_CONTENT_MISMATCH' ELSE problem END AS status
  FROM judged j LEFT JOIN firsts f USING (revision_id))
SELECT CAST(group_id AS BIGINT) AS group_id, revision_id, content_id, arrival, status,
       CASE WHEN status IN ('COMMITTED', 'REPLAYED') THEN coalesce(old_sequence, top + rank) END AS sequence
FROM final, tops"""


def group_log(spark, sf_dir):
    """All changes of the event log in three groups."""
    return fx.changes(spark, sf_dir).select(
        (F.col("path_id").cast(LONG) % 3).alias("group_id"), "sequence", "revision_id", "content_id"
    )


GROUP_LOG = f"""WITH {sql.CHANGES}, log AS (
  SELECT CAST(path_id AS BIGINT) % 3 AS group_id, sequence, revision_id, content_id FROM changes)"""


def changes_after_cursor(spark, sf_dir):
    return changelog.read_changes(group_log(spark, sf_dir), 1, 100)


CHANGES_AFTER_CURSOR = f"{GROUP_LOG} SELECT * FROM log WHERE group_id = 1 AND sequence > 100"


def provenance_of(log):
    key = F.col("sequence")
    return log.where("sequence % 301 <> 7").select(
        "group_id",
        "revision_id",
        F.when(key % 403 == 9, "other").otherwise(F.col("content_id")).alias("content_id"),
        text("a", key % 5).alias("author"),
        F.lit("t").alias("tag"),
    )


def page(spark, sf_dir):
    log = group_log(spark, sf_dir)
    return changelog.change_page(log, provenance_of(log), 1, 100, pl.PAGE_RECORDS)


def change_page(spark, sf_dir):
    return page(spark, sf_dir)[0].select("sequence", "revision_id", "content_id", "author", "row_error")


def change_page_summary(spark, sf_dir):
    return page(spark, sf_dir)[1]


PAGE_SQL = f"""{GROUP_LOG}, page AS (
  SELECT *, CASE WHEN sequence % 301 = 7 THEN 'UNSIGNED_CHANGE'
                 WHEN sequence % 403 = 9 THEN 'PROVENANCE_CONTENT_MISMATCH' END AS row_error
  FROM log WHERE group_id = 1 AND sequence > 100 ORDER BY sequence LIMIT {pl.PAGE_RECORDS})"""
CHANGE_PAGE = f"""{PAGE_SQL} SELECT sequence, revision_id, content_id,
  CASE WHEN sequence % 301 <> 7 THEN 'a' || (sequence % 5) END AS author, row_error FROM page"""
CHANGE_PAGE_SUMMARY = f"""{PAGE_SQL}, top AS (SELECT max(sequence) AS hw FROM log WHERE group_id = 1)
SELECT count(*) AS records, max(sequence) AS last_sequence, any_value(hw) AS high_watermark,
       any_value(hw) > coalesce(max(sequence), 100) AS has_more,
       min_by(row_error, sequence) FILTER (row_error IS NOT NULL) AS page_error FROM page, top"""


def log_pages(spark, sf_dir):
    return changelog.paginate(group_log(spark, sf_dir), pl.PAGE_RECORDS).select("group_id", "sequence", "page")


PAGED = f"""{GROUP_LOG}, paged AS (
  SELECT group_id, sequence, CAST(floor((row_number() OVER (PARTITION BY group_id ORDER BY sequence) - 1) / {pl.PAGE_RECORDS}) AS BIGINT) + 1 AS page
  FROM log)"""
LOG_PAGES = f"{PAGED} SELECT * FROM paged"


def log_page_summary(spark, sf_dir):
    return changelog.page_summary(log_pages(spark, sf_dir))


LOG_PAGE_SUMMARY = f"""{PAGED}, tops AS (SELECT group_id, max(sequence) AS hw FROM paged GROUP BY group_id)
SELECT group_id, page, count(*) AS records, min(sequence) AS first_sequence, max(sequence) AS last_sequence,
       any_value(hw) AS high_watermark, max(sequence) < any_value(hw) AS has_more
FROM paged JOIN tops USING (group_id) GROUP BY group_id, page"""


def upserts(spark, sf_dir):
    target = fx.heads(spark, sf_dir).select("path_id", "size", F.lit("old").alias("origin"))
    key = F.col("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").where("o_orderkey % 4 = 1").select(
        key.alias("path_id"), (key * 2).alias("size"), F.lit("first").alias("origin"), F.lit(1).alias("at")
    )
    again = rows.where("path_id % 3 = 0").withColumn("origin", F.lit("second")).withColumn("at", F.lit(2))
    return target, rows.unionByName(again)


def upsert_update(spark, sf_dir):
    return tables.upsert(*upserts(spark, sf_dir), ["path_id"], tables.UPDATE, "at")


def upsert_versions(spark, sf_dir):
    """Two upserts of a stored table, read at its third version."""
    target, rows = upserts(spark, sf_dir)
    table = KeyedTable.create(target, step_folder(spark, "heads"), ["path_id"])
    for at in (1, 2):
        table.upsert(rows.where(F.col("at") == at).drop("at"))
    return table.read()


def upsert_nothing(spark, sf_dir):
    return tables.upsert(*upserts(spark, sf_dir), ["path_id"], tables.NOTHING, "at")


UPSERT_UPDATE = f"""WITH {sql.HEADS}
SELECT o_orderkey AS path_id, o_orderkey * 2 AS size, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS origin
FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT path_id, size, 'old' FROM heads WHERE path_id % 4 <> 1"""
UPSERT_NOTHING = f"""WITH {sql.HEADS}
SELECT path_id, size, 'old' AS origin FROM heads
UNION ALL SELECT o_orderkey, o_orderkey * 2, 'first' FROM orders
WHERE o_orderkey % 4 = 1 AND o_orderkey NOT IN (SELECT path_id FROM heads)"""

# --- admission -------------------------------------------------------------------------------


def batch_validation(spark, sf_dir):
    """Orders in batches of 256 with one rule broken in some rows; some batches are merged."""
    key = F.col("o_orderkey")
    block = F.expr("o_orderkey div 256")
    content = F.sha2(key.cast("string"), 256)
    rows = fx.table(spark, sf_dir, "orders").select(
        F.when(block % 10 == 4, block - 1).otherwise(block).alias("batch_id"),
        key.alias("idx"),
        F.when(key % 1301 == 5, 0).when(key % 1409 == 7, key - 3).otherwise(key + 1).alias("sequence"),
        F.when(key % 1511 == 9, F.repeat(F.lit("0"), 32)).otherwise(F.lpad(key.cast("string"), 32, "9")).alias("revision_id"),
        F.when(key % 1601 == 11, "short").otherwise(content).alias("content_id"),
        F.lpad(F.col("o_custkey").cast("string"), 32, "a").alias("author"),
        F.when(key % 1709 == 13, "t").otherwise(F.repeat(F.lit("c"), 128)).alias("tag"),
        F.when(key % 1801 == 15, 67108865).otherwise(key).alias("payload_bytes"),
        F.when(key % 1901 == 17, "CHUNK").otherwise("MANIFEST").alias("payload_kind"),
        F.when(key % 2003 == 19, "x").otherwise(content).alias("payload_content_id"),
    )
    headers = rows.groupBy("batch_id").agg(F.max("idx").alias("top")).select(
        "batch_id", (F.col("top") + F.when(F.col("batch_id") % 7 == 2, 0).otherwise(1)).alias("high_watermark")
    )
    return admission.batch_errors(rows, headers, maximum_records=256)


BATCH_VALIDATION = """WITH blocks AS (SELECT *, o_orderkey AS k, CAST(floor(o_orderkey / 256) AS BIGINT) AS b FROM orders),
rows AS (
  SELECT CASE WHEN b % 10 = 4 THEN b - 1 ELSE b END AS batch_id, k AS idx,
         CASE WHEN k % 1301 = 5 THEN 0 WHEN k % 1409 = 7 THEN k - 3 ELSE k + 1 END AS sequence FROM blocks),
lagged AS (SELECT *, lag(sequence, 1, 0) OVER (PARTITION BY batch_id ORDER BY idx) AS previous FROM rows),
judged AS (
  SELECT *, CASE WHEN sequence < 1 OR sequence <= previous THEN 'INVALID_SEQUENCE'
    WHEN idx % 1511 = 9 THEN 'NIL_IDENTIFIER' WHEN idx % 1601 = 11 THEN 'INVALID_CONTENT_ID_LENGTH'
    WHEN idx % 1709 = 13 THEN 'INVALID_SIGNATURE_LENGTH' WHEN idx % 1801 = 15 THEN 'PAYLOAD_TOO_LARGE'
    WHEN idx % 1901 = 17 THEN 'UNEXPECTED_KIND' WHEN idx % 2003 = 19 THEN 'CONTENT_ID_MISMATCH' END AS error FROM lagged),
totals AS (
  SELECT batch_id, count(*) AS records, max(sequence) AS last, max(idx) + CASE WHEN batch_id % 7 = 2 THEN 0 ELSE 1 END AS hw,
         min_by(error, idx) FILTER (error IS NOT NULL) AS error, min(idx) FILTER (error IS NOT NULL) AS error_index
  FROM judged GROUP BY batch_id)
SELECT batch_id, hw AS high_watermark, records,
       CASE WHEN records > 256 THEN 'TOO_MANY_RECORDS' WHEN error IS NOT NULL THEN error
            WHEN last > hw THEN 'INVALID_HIGH_WATERMARK' END AS error,
       CASE WHEN records <= 256 THEN error_index END AS error_index FROM totals"""


def signed_changes(spark, sf_dir):
    """Orders signed by their customers; some tags are wrong, some changes come twice."""
    key = F.col("k")
    tag = ids.change_tag(
        text("key-", "author"), F.col("group_id"), F.col("author"), F.col("revision_id"), F.col("content_id")
    )
    once = order_changes(spark, sf_dir).withColumn("tag", F.when(key % 41 == 0, "wrong").otherwise(tag)).withColumn(
        "arrival", key
    )
    again = once.where("k % 15 = 2").withColumn("arrival", key + 1_000_000_000).withColumn(
        "tag", F.when(key % 45 == 2, "changed").otherwise(F.col("tag"))
    )
    return once, again


def stored_provenance(once):
    key = F.col("k")
    return once.where("k % 6 = 0").select(
        "group_id",
        "revision_id",
        F.when(key % 66 == 0, "other").otherwise(F.col("content_id")).alias("content_id"),
        "author",
        "tag",
    )


def authorize_changes(spark, sf_dir):
    once, again = signed_changes(spark, sf_dir)
    out = admission.authorize(
        once.unionByName(again), fx.members(spark, sf_dir), stored_provenance(once), order_objects(spark, sf_dir)
    )
    return out.select("revision_id", "arrival", "auth_status")


MANIFEST_RULE = "WHEN o.kind IS NULL THEN 'OBJECT_NOT_FOUND' WHEN o.kind <> 'MANIFEST' THEN 'OBJECT_KIND_MISMATCH'"


def signed_sql(manifest_rule: str) -> str:
    return f"""{ORDERS_SQL}, {sql.MEMBERS},
once AS (
  SELECT *, k AS arrival, CASE WHEN k % 41 = 0 THEN 'wrong' ELSE
    sha256(concat('key-', author, '|', group_id, '|', author, '|', revision_id, '|', content_id)) END AS tag
  FROM order_changes),
stored AS (
  SELECT revision_id, CASE WHEN k % 66 = 0 THEN 'other' ELSE content_id END AS s_content, author AS s_author, tag AS s_tag
  FROM once WHERE k % 6 = 0),
offered AS (
  SELECT *, 0 AS copy FROM once
  UNION ALL
  SELECT * REPLACE (k + 1000000000 AS arrival, CASE WHEN k % 45 = 2 THEN 'changed' ELSE tag END AS tag), 1
  FROM once WHERE k % 15 = 2),
alone AS (
  SELECT c.*, s_tag, CASE
    WHEN s_tag IS NOT NULL AND s_content = c.content_id AND s_author = c.author AND s_tag = c.tag THEN 'ALREADY_AUTHENTICATED'
    WHEN s_tag IS NOT NULL THEN 'MISMATCH' {manifest_rule} WHEN m.status IS NULL THEN 'UNKNOWN_MEMBER'
    WHEN m.status <> 'ACTIVE' THEN 'REVOKED'
    WHEN c.tag <> sha256(concat(m.tag_key, '|', c.group_id, '|', c.author, '|', c.revision_id, '|', c.content_id)) THEN 'INVALID'
    ELSE 'AUTHENTICATED' END AS a
  FROM offered c LEFT JOIN stored USING (revision_id) LEFT JOIN ready o ON o.content_id = c.content_id
  LEFT JOIN members m ON m.device = c.author),
authorized AS (
  SELECT *, CASE WHEN s_tag IS NULL AND arrival > first_ok AND tag = first_tag THEN 'ALREADY_AUTHENTICATED'
                 WHEN s_tag IS NULL AND arrival > first_ok THEN 'MISMATCH' ELSE a END AS auth_status
  FROM (SELECT *, min(arrival) FILTER (a = 'AUTHENTICATED') OVER (PARTITION BY revision_id) AS first_ok,
               arg_min(tag, arrival) FILTER (a = 'AUTHENTICATED') OVER (PARTITION BY revision_id) AS first_tag
        FROM alone))"""

AUTHORIZE_CHANGES = f"WITH {signed_sql(MANIFEST_RULE)} SELECT revision_id, arrival, auth_status FROM authorized"


def peer_tables(spark, sf_dir):
    once, _ = signed_changes(spark, sf_dir)
    remote = once.select(
        "group_id",
        (F.col("k") + 1).alias("sequence"),
        "revision_id",
        F.when(F.col("k") % 53 == 8, "zz").otherwise(F.col("revision_id")).alias("manifest_revision_id"),
        "content_id",
        "author",
        "tag",
    )
    local = pl.Tables(
        refs=lambda: order_refs(spark, sf_dir),
        objects=lambda: order_objects(spark, sf_dir),
        members=lambda: fx.members(spark, sf_dir),
        provenance=lambda: stored_provenance(once),
    )
    return remote, order_log(spark, sf_dir), local


def admitted_orders(spark, sf_dir):
    """Every order past sequence 200, sent by one active peer in pages of 64."""
    remote, log, local = peer_tables(spark, sf_dir)
    return pl.pull_pages(remote, log, local, 1, PEER, 200)


PEER = 0


def admit_batch(spark, sf_dir):
    admitted, _ = admitted_orders(spark, sf_dir)
    return admitted.select("page_id", "revision_id", "status", "sequence")


def page_verdicts(spark, sf_dir):
    _, verdicts = admitted_orders(spark, sf_dir)
    return verdicts.select("page_id", "committed", "replayed", "waiting", "failed", "high_watermark", "has_more", "accepted_through")


def pull_stream(spark, sf_dir):
    """The log after following a peer's change files: those of one micro-batch, a restart, as many more and a restart again."""
    remote, log, local = peer_tables(spark, sf_dir)
    types = [field.split() for field in pl.CHANGE.split(", ")]
    remote = remote.select(*[F.col(name).cast(kind).alias(name) for name, kind in types])
    known = local.provenance()
    known = known.select(*[F.col(c).cast("string").alias(c) for c in known.columns])
    local = replace(local, provenance=lambda: known)
    base = step_folder(spark, "pull")
    late = F.col("sequence") % 2 == 0
    for part in (~late, late):
        # At most as many files as one batch takes, so that many tasks write and read them.
        remote.where(part).coalesce(pl.BATCH_FILES).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):
            pl.start_pull(spark, f"{base}/in", base, "1", str(PEER), local, f"{base}/check", available_now=True).awaitTermination()
    pulled = spark.read.parquet(f"{base}/log").where("batch >= 0")
    top = pulled.agg(F.max("sequence").alias("top"), F.count(F.lit(1)).alias("n"), F.countDistinct("sequence").alias("distinct"))
    dense = F.expr("top = n AND n = distinct").alias("dense")
    return pulled.join(top.select(dense, F.lit(1).alias("one")), F.col("one") == 1).select("revision_id", "content_id", "dense")


def sent_envelopes(remote):
    """What went over the wire for each record of a peer; every thousandth payload is too large."""
    k = F.col("sequence") - 1
    content = F.sha2(k.cast("string"), 256)
    return remote.select(
        "sequence",
        F.lpad(F.col("sequence").cast("string"), 32, "9").alias("revision_id"),
        content.alias("content_id"),
        F.lpad(F.col("author").cast("string"), 32, "a").alias("author"),
        F.repeat(F.lit("c"), 128).alias("tag"),
        F.when(k % 1000 == 900, admission.MAXIMUM_PAYLOAD_BYTES + 1).otherwise(k).alias("payload_bytes"),
        F.lit("MANIFEST").alias("payload_kind"),
        content.alias("payload_content_id"),
    )


def pulled_and_woken(spark, sf_dir):
    """A round from sequence 200; then two parts in three arrive while every author but the peer is revoked."""
    remote, log, local = peer_tables(spark, sf_dir)
    objects, members = local.objects(), local.members()
    state = ex.new_state(spark, log, local.provenance())
    start = spark.range(1).select(F.lit(1).cast(LONG).alias("group_id"), F.lit(PEER).cast(LONG).alias("peer"), F.lit(200).cast(LONG).alias("sequence"))
    state = replace(state, progress=start)
    catalog = ex.Catalog(local.refs(), objects, members)
    first, verdicts, state = ex.pull_round(remote, sent_envelopes(remote), catalog, state, 1, PEER, 7_000)
    part = F.substring("content_id", 2, 20).cast(LONG)
    here = ~F.col("available") & F.col("content_id").startswith("p") & (part % 3 != 0)
    arrived = objects.where(here).select(F.lit(1).cast(LONG).alias("group_id"), "content_id")
    later = objects.withColumn("available", F.col("available") | here)
    status = F.when(F.col("device") == PEER, F.col("status")).otherwise("REVOKED")
    catalog = ex.Catalog(local.refs(), later, members.withColumn("status", status))
    second, state = ex.retry_waiting(catalog, state, arrived, 1, PEER)
    return first, verdicts, second, state


def pull_round(spark, sf_dir):
    first, _, second, _ = pulled_and_woken(spark, sf_dir)
    columns = ["revision_id", "status", "sequence"]
    return first.select(F.lit(1).alias("step"), *columns).unionByName(second.select(F.lit(2).alias("step"), *columns))


def pull_round_state(spark, sf_dir):
    """Sizes of the tables after both steps and the cursor."""
    _, verdicts, _, state = pulled_and_woken(spark, sf_dir)

    def rows(name, frame):
        return frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    counted = [
        rows("log", state.log),
        rows("provenance", state.provenance),
        rows("waiting", state.waiting),
        rows("requests", state.requests),
        rows("index", state.index),
        rows("refused", verdicts.where("error IS NOT NULL")),
        state.progress.select(F.lit("cursor").alias("name"), F.col("sequence").alias("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


def waiting_records(spark, sf_dir):
    """Orders that lacked parts, and what has become complete and what still waits when some parts arrive."""
    refs, objects = order_refs(spark, sf_dir), order_objects(spark, sf_dir)
    readable = objects.withColumn("available", F.col("available") & (F.substring("content_id", 2, 20).cast(LONG) % 7 != 3))
    waiting = order_changes(spark, sf_dir).select("group_id", "revision_id", "content_id")
    index = wt.waiting_index(waiting, refs, readable)
    arrived = fx.table(spark, sf_dir, "part").where("p_partkey % 7 = 3").select(text("p", "p_partkey").alias("content_id"))
    complete, rest = wt.wake(index, arrived)
    return complete.withColumn("missing", F.lit(0).cast(LONG)).unionByName(rest.groupBy("group_id", "revision_id").agg(F.max("missing").alias("missing")))


WAITING_RECORDS = """WITH absent AS (
  SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 40 <> 5 AND p_partkey % 7 <> 3)),
counted AS (
  SELECT k, count(*) AS n, count_if(p % 7 = 3 AND p IN (SELECT p_partkey FROM part)) AS arrived FROM absent GROUP BY k)
SELECT CAST(1 AS BIGINT) AS group_id, 'r' || k AS revision_id, n - arrived AS missing
FROM counted WHERE k IN (SELECT o_orderkey FROM orders)
  AND (arrived = n OR n - arrived > 0)"""


def next_cursor(spark, sf_dir):
    _, verdicts = admitted_orders(spark, sf_dir)
    return pl.next_cursor(verdicts, 200)


# Pulled records bring their manifests, so nothing is asked of the catalog about those.
ADMIT_SQL = f"""WITH {signed_sql('')}, brought_problems AS (
  SELECT manifest_id AS content_id, min_by(p, content_id) AS problem FROM chunk_problems GROUP BY manifest_id), paged AS (
  SELECT a.*, k + 1 AS peer_sequence, CAST(floor((row_number() OVER (ORDER BY k) - 1) / {pl.PAGE_RECORDS}) AS BIGINT) + 1 AS page_id
  FROM authorized a WHERE copy = 0 AND k + 1 > 200),
waits AS (SELECT DISTINCT manifest_id FROM order_refs WHERE content_id NOT IN (SELECT content_id FROM ready)),
peer AS (SELECT max(status) AS peer_status FROM members WHERE device = {PEER}),
joined AS (
  SELECT p.*, l.content_id AS old_content, l.sequence AS old_sequence, q.problem,
         CASE WHEN peer_status IS NULL THEN 'UNKNOWN_PEER' WHEN peer_status <> 'ACTIVE' THEN 'PEER_REVOKED'
              WHEN k % 53 = 8 THEN 'REVISION_MISMATCH' WHEN a NOT IN ('AUTHENTICATED', 'ALREADY_AUTHENTICATED') THEN a
              WHEN p.content_id IN (SELECT manifest_id FROM waits) THEN 'WAITING'
              WHEN l.content_id = p.content_id THEN 'REPLAYED' WHEN l.content_id IS NOT NULL THEN 'REVISION_CONTENT_MISMATCH'
              WHEN q.problem IS NOT NULL THEN q.problem ELSE 'COMMITTED' END AS status
  FROM paged p CROSS JOIN peer LEFT JOIN order_log l ON l.revision_id = p.revision_id
  LEFT JOIN brought_problems q ON q.content_id = p.content_id),
ranked AS (
  SELECT *, CASE WHEN status = 'REPLAYED' THEN old_sequence
                 WHEN status = 'COMMITTED' THEN (SELECT max(sequence) FROM order_log) + count_if(status = 'COMMITTED') OVER (ORDER BY arrival)
            END AS sequence FROM joined),
verdicts AS (
  SELECT page_id, count_if(status = 'COMMITTED') AS committed, count_if(status = 'REPLAYED') AS replayed,
         count_if(status = 'WAITING') AS waiting, count_if(status NOT IN ('COMMITTED', 'REPLAYED', 'WAITING')) AS failed,
         max(peer_sequence) AS last, (SELECT max(k) + 1 FROM order_changes) AS hw FROM ranked GROUP BY page_id),
judged AS (SELECT *, CASE WHEN waiting + failed = 0 THEN CASE WHEN last < hw THEN last ELSE hw END END AS accepted_through FROM verdicts)"""
ADMIT_BATCH = f"{ADMIT_SQL} SELECT page_id, revision_id, status, CAST(sequence AS BIGINT) AS sequence FROM ranked"
PAGE_VERDICTS = f"""{ADMIT_SQL} SELECT page_id, CAST(committed AS BIGINT) AS committed, CAST(replayed AS BIGINT) AS replayed,
  CAST(waiting AS BIGINT) AS waiting, CAST(failed AS BIGINT) AS failed, hw AS high_watermark, last < hw AS has_more, accepted_through FROM judged"""
NEXT_CURSOR = f"""{ADMIT_SQL}, stop AS (SELECT min(page_id) AS stop_at FROM judged WHERE accepted_through IS NULL),
cursor AS (SELECT coalesce(max(accepted_through), 200) AS sequence FROM judged, stop WHERE stop_at IS NULL OR page_id < stop_at)
SELECT sequence, sequence <= 200 AND stop_at IS NOT NULL AS stalled FROM cursor, stop"""


ROUND_SQL = f"""{ADMIT_SQL}, bad AS (SELECT coalesce(min(page_id), 1000000000) AS page FROM paged WHERE k % 1000 = 900),
step1 AS (SELECT r.*, CASE WHEN status = 'REPLAYED' THEN old_sequence
            WHEN status = 'COMMITTED' THEN (SELECT max(sequence) FROM order_log) + count_if(status = 'COMMITTED') OVER (ORDER BY arrival) END AS seq
          FROM (SELECT * EXCLUDE (sequence) FROM ranked) r, bad WHERE page_id < page),
lacking AS (
  SELECT DISTINCT manifest_id, content_id FROM order_refs
  WHERE content_id NOT IN (SELECT content_id FROM ready) AND manifest_id IN (SELECT content_id FROM step1 WHERE status = 'WAITING')),
still AS (SELECT * FROM lacking WHERE content_id NOT IN (SELECT content_id FROM order_objects WHERE CAST(substr(content_id, 2) AS BIGINT) % 3 <> 0)),
step2 AS (
  SELECT revision_id, content_id, arrival, old_content, old_sequence,
         CASE WHEN old_content = content_id THEN 'REPLAYED' WHEN old_content IS NOT NULL THEN 'REVISION_CONTENT_MISMATCH'
              WHEN content_id IN (SELECT manifest_id FROM order_refs JOIN order_objects o USING (content_id) WHERE o.kind <> 'CHUNK')
              THEN 'OBJECT_KIND_MISMATCH' ELSE 'COMMITTED' END AS status
  FROM step1 WHERE status = 'WAITING' AND content_id NOT IN (SELECT manifest_id FROM still)),
tops AS (SELECT greatest((SELECT max(sequence) FROM order_log), coalesce((SELECT max(seq) FROM step1 WHERE status = 'COMMITTED'), 0)) AS top)"""
PULL_ROUND = f"""{ROUND_SQL}
SELECT CAST(1 AS INTEGER) AS step, revision_id, status, CAST(seq AS BIGINT) AS sequence FROM step1
UNION ALL SELECT 2, revision_id, status, CAST(CASE WHEN status = 'REPLAYED' THEN old_sequence WHEN status = 'COMMITTED'
  THEN top + count_if(status = 'COMMITTED') OVER (ORDER BY arrival) END AS BIGINT) FROM step2, tops"""
_UNAUTHENTICATED = ", ".join(f"'{status}'" for status in ex.UNAUTHENTICATED)
PULL_ROUND_STATE = f"""{ROUND_SQL}, stop AS (
  SELECT least((SELECT page FROM bad), coalesce(min(page_id), 1000000000)) AS stop_at FROM judged WHERE accepted_through IS NULL)
SELECT 'log' AS name, (SELECT count(*) FROM order_log) + (SELECT count(*) FROM step1 WHERE status = 'COMMITTED')
  + (SELECT count(*) FROM step2 WHERE status = 'COMMITTED') AS n
UNION ALL SELECT 'provenance', (SELECT count(*) FROM stored) + (SELECT count(*) FROM step1
  WHERE status NOT IN ({_UNAUTHENTICATED}) AND revision_id NOT IN (SELECT revision_id FROM stored))
UNION ALL SELECT 'waiting', (SELECT count(*) FROM step1 WHERE status = 'WAITING') - (SELECT count(*) FROM step2)
UNION ALL SELECT 'requests', (SELECT count(DISTINCT content_id) FROM still)
UNION ALL SELECT 'index', (SELECT count(*) FROM still)
UNION ALL SELECT 'refused', (SELECT count(DISTINCT page_id) FROM paged WHERE k % 1000 = 900)
UNION ALL SELECT 'cursor', coalesce(max(accepted_through), 200) FROM judged, stop WHERE page_id < stop_at"""


_PULLED = ADMIT_SQL.replace("AND k + 1 > 200", "").replace(
    "LEFT JOIN order_log l ON", "LEFT JOIN (SELECT * FROM order_log WHERE false) l ON"
)
PULL_STREAM = f"{_PULLED} SELECT revision_id, content_id, true AS dense FROM ranked WHERE status = 'COMMITTED'"


def advance_watermarks(spark, sf_dir):
    progress = fx.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
        F.lit(1).cast(LONG).alias("group_id"), F.col("c_custkey").alias("peer"), (F.col("c_custkey") * 37 % 2000).alias("sequence")
    )
    updates = fx.table(spark, sf_dir, "orders").select(
        F.lit(1).cast(LONG).alias("group_id"), F.col("o_custkey").alias("peer"), (F.col("o_orderkey") * 31 % 3000).alias("sequence")
    )
    return admission.advance_watermark(progress, updates)


ADVANCE_WATERMARKS = """WITH rows AS (
  SELECT c_custkey AS peer, c_custkey * 37 % 2000 AS sequence FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT o_custkey, o_orderkey * 31 % 3000 FROM orders)
SELECT CAST(1 AS BIGINT) AS group_id, peer, max(sequence) AS sequence FROM rows GROUP BY peer"""

# --- requests and transfers ------------------------------------------------------------------


def wanted(spark, sf_dir):
    """Parts a supplier is asked for, with hex ids."""
    return fx.table(spark, sf_dir, "lineitem").select(
        F.lit(1).cast(LONG).alias("group_id"),
        F.col("l_suppkey").alias("peer"),
        fx.hex_id("l_partkey").alias("content_id"),
        "l_partkey",
        "l_orderkey",
    )


def part_objects(spark, sf_dir):
    return fx.objects(spark, sf_dir).withColumn("content_id", fx.hex_id("content_id"))


def queue(spark, sf_dir):
    return (
        wanted(spark, sf_dir)
        .where("l_partkey % 7 = 0")
        .groupBy("group_id", "peer", "content_id", "l_partkey")
        .agg(F.min("l_orderkey").alias("requested_at_ms"), F.count(F.lit(1)).alias("attempts"))
        .withColumn("last_attempt_ms", F.when(F.col("attempts") > 1, F.col("requested_at_ms") + 5))
    )


WANTED_SQL = f"""{sql.OBJECTS}, wanted AS (
  SELECT CAST(1 AS BIGINT) AS group_id, l_suppkey AS peer, sha256(CAST(l_partkey AS VARCHAR)) AS content_id, l_partkey, l_orderkey
  FROM lineitem),
queue AS (
  SELECT group_id, peer, content_id, l_partkey, min(l_orderkey) AS requested_at_ms, count(*) AS attempts,
         CASE WHEN count(*) > 1 THEN min(l_orderkey) + 5 END AS last_attempt_ms
  FROM wanted WHERE l_partkey % 7 = 0 GROUP BY ALL)"""


def request_enqueue(spark, sf_dir):
    return rq.enqueue(queue(spark, sf_dir), wanted(spark, sf_dir), part_objects(spark, sf_dir), NOW)


REQUEST_ENQUEUE = f"""WITH {WANTED_SQL}
SELECT DISTINCT group_id, peer, content_id, {NOW} AS requested_at_ms, CAST(0 AS BIGINT) AS attempts,
       CAST(NULL AS BIGINT) AS last_attempt_ms
FROM wanted w WHERE l_partkey NOT IN (SELECT content_id FROM objects WHERE available)
  AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.peer = w.peer AND q.content_id = w.content_id)"""


def request_pending(spark, sf_dir):
    return rq.pending_requests(queue(spark, sf_dir), 5).select("peer", "content_id", "requested_at_ms", "position")


REQUEST_PENDING = f"""WITH {WANTED_SQL}
SELECT peer, content_id, requested_at_ms,
       row_number() OVER (PARTITION BY peer ORDER BY requested_at_ms, content_id) AS position
FROM queue QUALIFY position <= 5"""


def request_attempts(spark, sf_dir):
    rows = queue(spark, sf_dir)
    return rq.mark_attempts(rows, rows.where("l_partkey % 2 = 0"), NOW).drop("l_partkey")


REQUEST_ATTEMPTS = f"""WITH {WANTED_SQL}
SELECT group_id, peer, content_id, requested_at_ms, attempts + CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS attempts,
       CASE WHEN l_partkey % 2 = 0 THEN {NOW} ELSE last_attempt_ms END AS last_attempt_ms FROM queue"""


def request_clear(spark, sf_dir):
    admitted = part_objects(spark, sf_dir).where("available").select(F.lit(1).cast(LONG).alias("group_id"), "content_id")
    return rq.clear_requests(queue(spark, sf_dir), admitted).select("peer", "content_id", "attempts")


REQUEST_CLEAR = f"""WITH {WANTED_SQL}
SELECT peer, content_id, attempts FROM queue WHERE l_partkey NOT IN (SELECT content_id FROM objects WHERE available)"""


def request_batches(spark, sf_dir):
    missing = missing_objects(wanted(spark, sf_dir), part_objects(spark, sf_dir), ["peer"])
    out = rq.request_batches(missing, ["peer"], n=16)
    return out.withColumn("content_ids", F.array_join("content_ids", ","))


REQUEST_BATCHES = f"""WITH {WANTED_SQL}, missing AS (
  SELECT DISTINCT peer, content_id FROM wanted WHERE l_partkey NOT IN (SELECT content_id FROM objects WHERE available)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY content_id) - 1 AS rn FROM missing)
SELECT peer, CAST(floor(rn / 16) AS BIGINT) + 1 AS request, string_agg(content_id, ',' ORDER BY content_id) AS content_ids,
       count(*) AS ids FROM ranked GROUP BY peer, floor(rn / 16)"""


def replayed_transfers(spark, sf_dir):
    events = fx.transfer_events(spark, sf_dir)
    asked = events.select("peer", "content_id").distinct().where("CAST(content_id AS BIGINT) % 13 <> 2")
    have = fx.objects(spark, sf_dir).select(
        F.col("content_id").cast("string").alias("content_id"), (F.col("content_id") % 17 == 5).alias("available")
    )
    return tr.replay_transfers(events, asked, have)


def transfer_replay(spark, sf_dir):
    return replayed_transfers(spark, sf_dir).outcomes


def shared_transfers(spark, sf_dir):
    events = fx.transfer_events(spark, sf_dir)
    asked = events.select("content_id").distinct().where("CAST(content_id AS BIGINT) % 13 <> 2")
    number = F.col("content_id").cast(LONG)
    shared = [F.concat(F.lit("p"), number % 2).alias("peer"), F.expr("CAST(CAST(content_id AS BIGINT) div 2 AS STRING)").alias("content_id")]
    rest = [c for c in events.columns if c not in ("peer", "content_id")]
    return events.select(*shared, *rest), asked.select(*shared)


def transfer_stream(spark, sf_dir):
    """The transfers of ``transfer_peers`` as a stream that is stopped half-way and started again."""
    events, asked = shared_transfers(spark, sf_dir)
    events = materialized(events.select(*[field.split()[0] for field in ts.EVENT.split(", ")]))
    none = events.where("false").select("content_id", F.lit(True).alias("available"))
    base = step_folder(spark, "transfers")
    middle = events.agg(F.percentile_approx("event_id", 0.5).alias("m")).first()["m"]
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        events.where(part).write.mode("append").parquet(f"{base}/in")
        run = ts.start_transfers(spark, f"{base}/in", base, lambda: asked, lambda: none, f"{base}/check", available_now=True)
        run.awaitTermination()
    return ts.read_outcomes(spark, base)


def transfer_peers(spark, sf_dir):
    """Transfers of objects that two peers send at the same time."""
    events, asked = shared_transfers(spark, sf_dir)
    none = events.where("false").select("content_id", F.lit(True).alias("available"))
    return tr.replay_transfers(events, asked, none).outcomes


def transfer_hot_key(spark, sf_dir):
    """Statuses when all events are of the same transfer."""
    events = fx.one_transfer(spark, sf_dir)
    none = events.where("false").select("content_id", F.lit(True).alias("available"))
    return tr.replay_transfers(events, events.select("peer", "content_id").distinct(), none).outcomes


TRANSFER_HOT_KEY = f"""WITH RECURSIVE ev AS (
  SELECT event_id, event_id // 500 AS block, CAST(floor(value * 10) AS BIGINT) + 1 AS len FROM events),
counted AS (SELECT *, CASE WHEN event_id % 9 <> 0 THEN len ELSE 0 END AS n FROM ev),
sized AS (SELECT block, CAST(sum(n) AS BIGINT) + CASE WHEN block % 16 = 15 THEN 0 ELSE 5 END AS size FROM counted GROUP BY block),
totals AS (SELECT 1 AS object_no),
ops AS (
  SELECT 1 AS object_no, event_id * 3 + 1 AS event_id, 'APPEND' AS op, NULL AS request_id, NULL AS size,
         CAST(CASE WHEN event_id % 9 <> 0 THEN coalesce(sum(n) OVER (PARTITION BY block ORDER BY event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS BIGINT) AS start_offset, len FROM counted
  UNION ALL SELECT 1, block * 1500, 'BEGIN', repeat('7', 32), size, NULL, NULL FROM sized
  UNION ALL SELECT 1, block * 1500 + 1499, CASE WHEN block % 2 = 0 THEN 'CANCEL' ELSE 'COMPLETE' END, NULL, NULL, NULL, NULL FROM sized),
{sql.TRANSFER_FOLD.replace("numbered AS (", "numbered AS MATERIALIZED (").replace("(object_no % 17 = 5 AND object_no IN (SELECT p_partkey FROM part))", "false")}
SELECT 'p' AS peer, 'x' AS content_id, event_id, op, status, received FROM fold WHERE rn > 0"""


def transfer_progress(spark, sf_dir):
    return tr.transfer_progress(replayed_transfers(spark, sf_dir).states)


TRANSFER_REPLAY = f"""WITH RECURSIVE {sql.TRANSFERS}
SELECT 'p' || (object_no % 3) AS peer, CAST(object_no AS VARCHAR) AS content_id, event_id, op, status, received
FROM fold WHERE rn > 0"""
TRANSFER_PEERS = f"""WITH RECURSIVE {sql.TRANSFERS.replace("(object_no % 17 = 5 AND object_no IN (SELECT p_partkey FROM part))", "false")},
done AS (SELECT object_no // 2 AS content, min(event_id) AS done_at FROM fold WHERE status = 'STORED' GROUP BY object_no // 2)
SELECT 'p' || (f.object_no % 2) AS peer, CAST(f.object_no // 2 AS VARCHAR) AS content_id, f.event_id, f.op,
       CASE WHEN done_at IS NULL OR f.event_id <= done_at THEN f.status
            WHEN f.op = 'BEGIN' AND n.request_id = repeat('0', 32) THEN 'NIL_REQUEST'
            WHEN f.op = 'BEGIN' AND (n.size < 1 OR n.size > 67108864) THEN 'SIZE_OUT_OF_RANGE'
            WHEN f.op = 'BEGIN' THEN 'ALREADY_PRESENT' WHEN f.op = 'CANCEL' THEN 'NOTHING_TO_CANCEL'
            ELSE 'NOT_FOUND' END AS status,
       CASE WHEN done_at IS NULL OR f.event_id <= done_at THEN f.received END AS received
FROM fold f JOIN numbered n ON n.object_no = f.object_no AND n.rn = f.rn
LEFT JOIN done ON done.content = f.object_no // 2"""
TRANSFER_PROGRESS = f"""WITH RECURSIVE {sql.TRANSFERS}
SELECT 'p' || (object_no % 3) AS peer, CAST(object_no AS VARCHAR) AS content_id, size, received,
       CASE WHEN present THEN 'COMPLETE' WHEN is_open THEN 'OPEN' ELSE 'IDLE' END AS progress
FROM fold QUALIFY row_number() OVER (PARTITION BY object_no ORDER BY rn DESC) = 1"""


def pull_events(spark, sf_dir):
    kinds = F.create_map(
        *[F.lit(x) for pair in (("click", "PAGE"), ("view", "STORED"), ("signup", "COMMITTED"), ("purchase", "REUSED"), ("error", "FAILED")) for x in pair]
    )
    return fx.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("peer"),
        kinds[F.col("event_type")].alias("kind"),
        F.floor(F.col("value") * 100).cast(LONG).alias("bytes"),
    )


def pull_report(spark, sf_dir):
    return reports.pull_report(pull_events(spark, sf_dir))


PULL_REPORT = """SELECT user_id % 7 AS peer, count_if(event_type = 'click')::BIGINT AS pages_received,
  count_if(event_type = 'signup')::BIGINT AS records_committed, CAST(0 AS BIGINT) AS records_replayed,
  CAST(0 AS BIGINT) AS objects_requested, count_if(event_type = 'view')::BIGINT AS objects_stored,
  count_if(event_type = 'purchase')::BIGINT AS objects_reused,
  sum(CASE WHEN event_type = 'view' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END)::BIGINT AS bytes_received,
  count_if(event_type = 'error')::BIGINT AS failures FROM events GROUP BY user_id % 7"""


def pull_report_cursors(spark, sf_dir):
    """Totals with the cursor of every peer; one peer has none."""
    pages = fx.table(spark, sf_dir, "events").where("event_type = 'click'")
    progress = pages.select((F.col("user_id") % 7).alias("peer"), F.col("event_id").alias("sequence")).where("peer <> 5")
    return reports.pull_report(pull_events(spark, sf_dir), progress).select(
        "peer", "pages_received", "records_committed", "peer_high_watermark"
    )


PULL_REPORT_CURSORS = """SELECT user_id % 7 AS peer, count_if(event_type = 'click')::BIGINT AS pages_received,
  count_if(event_type = 'signup')::BIGINT AS records_committed,
  coalesce(max(event_id) FILTER (event_type = 'click' AND user_id % 7 <> 5), 0) AS peer_high_watermark
FROM events GROUP BY user_id % 7"""


def serve_report(spark, sf_dir):
    """What was sent to every peer."""
    kinds = {"click": "PAGE_SENT", "view": "OBJECT_SENT", "signup": "ACKNOWLEDGED"}
    named = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("OTHER"))
    events = fx.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("peer"), named.alias("kind"), F.floor(F.col("value") * 100).alias("bytes")
    )
    return reports.serve_report(events)


SERVE_REPORT = """SELECT user_id % 7 AS peer, count_if(event_type = 'click')::BIGINT AS pages_sent,
  count_if(event_type = 'view')::BIGINT AS objects_sent,
  sum(CASE WHEN event_type = 'view' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END)::BIGINT AS bytes_sent,
  count_if(event_type = 'signup')::BIGINT AS acknowledgements_received FROM events GROUP BY user_id % 7"""


def sync_report(spark, sf_dir):
    rows = pull_events(spark, sf_dir).withColumn(
        "kind", F.when((F.col("kind") == "FAILED") & (F.col("peer") != 3), "PAGE").otherwise(F.col("kind"))
    )
    return reports.sync_report(reports.pull_report(rows))


SYNC_REPORT = """WITH r AS (
  SELECT user_id % 7 AS peer, count_if(event_type = 'click' OR (event_type = 'error' AND user_id % 7 <> 3)) AS p,
         count_if(event_type = 'signup') AS c, count_if(event_type = 'view') AS s,
         sum(CASE WHEN event_type = 'view' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) AS b,
         count_if(event_type = 'error' AND user_id % 7 = 3) AS f FROM events GROUP BY user_id % 7)
SELECT count_if(f = 0)::BIGINT AS peers_synchronized, count_if(f > 0)::BIGINT AS peers_failed, sum(p)::BIGINT AS pages_received,
       sum(c)::BIGINT AS records_committed, sum(s)::BIGINT AS objects_stored, sum(b)::BIGINT AS bytes_received FROM r"""



def sync_report_replay(spark, sf_dir):
    """A round's totals with those of the replay that followed it."""
    return reports.sync_report(reports.pull_report(pull_events(spark, sf_dir)), versions.replay_report(spark, sf_dir))


SYNC_REPORT_REPLAY = f"""SELECT * FROM ({versions.REPLAY_REPORT}), (
  SELECT count_if(f = 0)::BIGINT AS peers_synchronized, count_if(f > 0)::BIGINT AS peers_failed, sum(p)::BIGINT AS pages_received,
         sum(c)::BIGINT AS records_committed, sum(s)::BIGINT AS objects_stored, sum(b)::BIGINT AS bytes_received FROM (
    SELECT count_if(event_type = 'click') AS p, count_if(event_type = 'signup') AS c, count_if(event_type = 'view') AS s,
           sum(CASE WHEN event_type = 'view' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) AS b,
           count_if(event_type = 'error') AS f FROM events GROUP BY user_id % 7))"""

# --- retention ---------------------------------------------------------------------------------


def counted_parts(spark, sf_dir):
    """Parts with all five kinds of pins; edges come from all line items."""
    orders = fx.table(spark, sf_dir, "orders")
    as_content = orders.select(F.col("o_orderkey").alias("content_id"), "o_orderkey")
    edges = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner_id"), F.col("l_partkey").alias("content_id")
    )
    return rt.reference_counts(
        fx.objects(spark, sf_dir),
        changes=as_content.where("o_orderkey % 4 = 0"),
        heads=as_content.where("o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0"),
        pending=orders.where("o_orderkey % 50 = 3").select((F.col("o_orderkey") % 1000).alias("target_content_id")),
        provenance=as_content.where("o_orderkey % 3 = 0"),
        edges=edges,
    )


def reference_counts(spark, sf_dir):
    return counted_parts(spark, sf_dir).select("content_id", "reference_count")


def maintained_counts(spark, sf_dir):
    """Counts kept up through ten batches of inserted, moved and deleted pins."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    nothing = F.lit(None).cast(LONG)

    def pins(frame, new, old=nothing):
        return frame.select("k", old.alias("old_content_id"), new.alias("new_content_id"))

    heads = orders.where("k % 11 <> 0 AND k % 2 = 0")
    edges = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey").distinct()
    once = [
        pins(orders.where("k % 4 = 0"), F.col("k")),
        pins(orders.where("k % 50 = 3"), F.col("k") % 1000),
        pins(orders.where("k % 3 = 0"), F.col("k")),
        pins(edges, F.col("l_partkey")),
        # A head is set to another object first, and moves in the next batch.
        pins(heads, F.col("k") % 77),
        pins(orders.where("k % 5 = 0"), F.col("k")),
    ]
    then = [pins(heads, F.col("k"), F.col("k") % 77), pins(orders.where("k % 5 = 0"), nothing, F.col("k"))]
    first, second = (reduce(lambda a, b: a.unionByName(b), frames) for frames in (once, then))
    events = materialized(
        first.withColumn("batch", F.col("k") % 9).unionByName(second.withColumn("batch", F.col("k") % 9 + 1))
    )
    none = events.where("false").select(nothing.alias("content_id"), nothing.alias("n"))
    counts = KeyedTable.create(none, step_folder(spark, "counts"), ["content_id"])
    for batch in range(10):
        rt.maintain_counts(counts, events.where(F.col("batch") == batch))
    return rt.counted_objects(fx.objects(spark, sf_dir), counts).select("content_id", "reference_count")


COUNTED_SQL = f"""{sql.OBJECTS}, pins AS (
  SELECT o_orderkey AS content_id FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey % 1000 FROM orders WHERE o_orderkey % 50 = 3
  UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
counts AS (SELECT content_id, count(*) AS n FROM pins GROUP BY content_id),
counted AS (SELECT o.*, coalesce(n, 0) AS reference_count FROM objects o LEFT JOIN counts USING (content_id))"""
REFERENCE_COUNTS = f"WITH {COUNTED_SQL} SELECT content_id, reference_count FROM counted"


def loosely_counted(spark, sf_dir):
    """References of all lines; objects are the parts and as many again that no line names."""
    edges = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner_id"), F.col("l_partkey").alias("content_id")
    )
    objects = fx.objects(spark, sf_dir)
    strays = objects.withColumn("content_id", F.col("content_id") + 10_000_000)
    return rt.reference_counts(objects.unionByName(strays), edges=edges)


def gc_candidates(spark, sf_dir):
    return rt.gc_candidates(loosely_counted(spark, sf_dir), 43_200_000, 100).select("content_id", "size", "verified_at_ms")


def gc_report(spark, sf_dir):
    return rt.gc_report(rt.gc_candidates(loosely_counted(spark, sf_dir), 43_200_000, 100))


GC_CANDIDATES = f"""WITH {sql.OBJECTS}, catalog AS (
  SELECT content_id, size, verified_at_ms FROM objects
  UNION ALL SELECT content_id + 10000000, size, verified_at_ms FROM objects)
SELECT content_id, size, verified_at_ms FROM catalog
WHERE content_id NOT IN (SELECT l_partkey FROM lineitem) AND verified_at_ms <= 43200000 ORDER BY verified_at_ms, content_id LIMIT 100"""
GC_REPORT = f"SELECT count(*) AS removed_objects, coalesce(sum(size), 0)::BIGINT AS removed_bytes FROM ({GC_CANDIDATES})"


def gc_sweep(spark, sf_dir):
    """Everything no order with a round key owns."""
    roots = order_changes(spark, sf_dir).where("k % 40 = 0").select("content_id")
    edges = order_refs(spark, sf_dir).withColumnRenamed("manifest_id", "owner_id")
    return rt.gc_sweep(order_objects(spark, sf_dir), roots, edges).select("content_id", "kind")


GC_SWEEP = f"""WITH {ORDERS_SQL}, roots AS (SELECT content_id FROM order_changes WHERE k % 40 = 0)
SELECT content_id, kind FROM order_objects WHERE content_id NOT IN (SELECT content_id FROM roots)
  AND content_id NOT IN (SELECT content_id FROM order_refs WHERE manifest_id IN (SELECT content_id FROM roots))"""


def catalog_audit(spark, sf_dir):
    key = F.col("p_partkey")
    parts = fx.table(spark, sf_dir, "part")
    stored = parts.where("p_partkey % 7 <> 3").select(key.alias("content_id"), F.col("p_size").cast(LONG).alias("length"))
    strays = parts.where("p_partkey % 50 = 0").select((key + 10_000_000).alias("content_id"), F.lit(5).cast(LONG).alias("length"))
    return rt.audit_catalog(fx.objects(spark, sf_dir), stored.unionByName(strays))


CATALOG_AUDIT = f"""WITH {sql.OBJECTS}, stored AS (
  SELECT p_partkey AS content_id, CAST(p_size AS BIGINT) AS stored_bytes FROM part WHERE p_partkey % 7 <> 3
  UNION ALL SELECT p_partkey + 10000000, 5 FROM part WHERE p_partkey % 50 = 0)
SELECT content_id, o.available AS was_available, stored_bytes,
       CASE WHEN o.available IS NULL THEN 'ORPHAN' WHEN o.available AND stored_bytes IS NULL THEN 'DEMOTE'
            WHEN NOT o.available AND stored_bytes IS NULL THEN 'ABSENT' ELSE 'OK' END AS status,
       coalesce(o.available, false) AND stored_bytes IS NOT NULL AS available
FROM objects o FULL OUTER JOIN stored USING (content_id)"""


def transfer_audit(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = fx.table(spark, sf_dir, "orders")
    rows = orders.where("o_orderkey % 9 <> 8").select(
        F.col("o_custkey").alias("peer"), key.alias("content_id"), (key % 100 + 10).alias("size"), (key % 10).alias("received")
    )
    actual = F.when(key % 5 == 1, key % 10 + 1).when(key % 7 == 2, key % 100 + 11).otherwise(key % 10)
    files = orders.where("o_orderkey % 6 <> 5").select(F.col("o_custkey").alias("peer"), key.alias("content_id"), actual.alias("length"))
    return rt.audit_transfers(rows, files)


TRANSFER_AUDIT = """WITH t AS (
  SELECT o_custkey AS peer, o_orderkey AS content_id, o_orderkey % 100 + 10 AS expected, o_orderkey % 10 AS received
  FROM orders WHERE o_orderkey % 9 <> 8),
f AS (
  SELECT o_custkey AS peer, o_orderkey AS content_id, CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 10 + 1
         WHEN o_orderkey % 7 = 2 THEN o_orderkey % 100 + 11 ELSE o_orderkey % 10 END AS actual
  FROM orders WHERE o_orderkey % 6 <> 5),
j AS (
  SELECT *, CASE WHEN expected IS NULL THEN 'ORPHAN' WHEN actual IS NULL THEN 'DROP_ABSENT'
                 WHEN actual > expected THEN 'DROP_OVERSIZED' WHEN actual <> received THEN 'ADOPT_ACTUAL' ELSE 'OK' END AS status
  FROM t FULL OUTER JOIN f USING (peer, content_id))
SELECT *, CASE WHEN status IN ('OK', 'ADOPT_ACTUAL') THEN actual END AS received_after FROM j"""

# --- members and status --------------------------------------------------------------------------


def additions(spark, sf_dir):
    key = F.col("c_custkey")
    once = fx.table(spark, sf_dir, "customer").select(
        F.lit(1).cast(LONG).alias("group_id"),
        key.alias("device"),
        F.when(key % 12 == 0, "stolen").otherwise(text("key-", key)).alias("tag_key"),
        F.when(key % 18 == 1, "GUEST").when(key % 25 == 0, "OWNER").otherwise("MEMBER").alias("role"),
        key.alias("position"),
    )
    again = once.where("device % 20 = 3").withColumn("position", F.col("position") + 1_000_000_000).withColumn(
        "role", F.when(F.col("device") % 3 == 0, "OWNER").otherwise(F.col("role"))
    )
    return once.unionByName(again)


def member_additions(spark, sf_dir):
    out = mb.member_additions(fx.members(spark, sf_dir), additions(spark, sf_dir))
    return out.select("device", "position", "role", "status")


ADDITIONS_SQL = f"""{sql.MEMBERS}, once AS (
  SELECT c_custkey AS device, CASE WHEN c_custkey % 12 = 0 THEN 'stolen' ELSE 'key-' || c_custkey END AS tag_key,
         CASE WHEN c_custkey % 18 = 1 THEN 'GUEST' WHEN c_custkey % 25 = 0 THEN 'OWNER' ELSE 'MEMBER' END AS role,
         c_custkey AS position FROM customer),
asked AS (
  SELECT * FROM once UNION ALL
  SELECT device, tag_key, CASE WHEN device % 3 = 0 THEN 'OWNER' ELSE role END, position + 1000000000 FROM once WHERE device % 20 = 3),
judged AS (
  SELECT a.*, CASE WHEN m.device IS NULL AND a.position = o.position THEN 'ADDED'
                   WHEN a.tag_key <> coalesce(m.tag_key, o.tag_key) THEN 'KEY_MISMATCH'
                   WHEN a.role <> coalesce(m.role, o.role) THEN 'ROLE_MISMATCH'
                   WHEN m.status = 'REVOKED' THEN 'REVOKED' ELSE 'ALREADY_ACTIVE' END AS status
  FROM asked a LEFT JOIN members m USING (device) JOIN once o USING (device))"""
MEMBER_ADDITIONS = f"WITH {ADDITIONS_SQL} SELECT device, position, role, status FROM judged"


def members_after(spark, sf_dir):
    members = fx.members(spark, sf_dir)
    return mb.add_members(members, mb.member_additions(members, additions(spark, sf_dir)), NOW).drop("tag_key")


MEMBERS_AFTER = f"""WITH {ADDITIONS_SQL}
SELECT CAST(1 AS BIGINT) AS group_id, device, role, status, CAST(0 AS BIGINT) AS added_at_ms, CAST(revoked_at_ms AS BIGINT) AS revoked_at_ms FROM members
UNION ALL SELECT 1, device, role, 'ACTIVE', {NOW}, NULL FROM judged WHERE status = 'ADDED'"""


def member_revocations(spark, sf_dir):
    devices = additions(spark, sf_dir).where("device % 9 = 0")
    return mb.revoke_members(fx.members(spark, sf_dir), devices, NOW).select("device", "status", "revoked_at_ms", "changed")


MEMBER_REVOCATIONS = f"""WITH {sql.MEMBERS}, j AS (SELECT *, device % 9 = 0 AND status = 'ACTIVE' AS changed FROM members)
SELECT device, CASE WHEN changed THEN 'REVOKED' ELSE status END AS status,
       CASE WHEN changed THEN {NOW} ELSE CAST(revoked_at_ms AS BIGINT) END AS revoked_at_ms, changed FROM j"""


def peer_status(spark, sf_dir):
    key = F.col("c_custkey")
    customers = fx.table(spark, sf_dir, "customer")
    peers = customers.select((key % 4).alias("group_id"), key.alias("peer"))
    progress = customers.where("c_custkey % 3 <> 0").select((key % 4).alias("group_id"), key.alias("peer"), (key * 7 % 1000).alias("sequence"))
    queued = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 4).alias("group_id"), F.col("l_partkey").alias("peer"), F.col("l_orderkey").alias("content_id")
    ).distinct()
    return reports.replication_status(group_log(spark, sf_dir), peers, progress, queued)


def replication_status(spark, sf_dir):
    return peer_status(spark, sf_dir)


def status_totals(spark, sf_dir):
    return reports.status_totals(peer_status(spark, sf_dir))


STATUS_SQL = f"""{GROUP_LOG}, tops AS (SELECT group_id, max(sequence) AS top FROM log GROUP BY group_id),
queued AS (SELECT l_partkey AS peer, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey),
status AS (
  SELECT c_custkey % 4 AS group_id, c_custkey AS peer, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 7 % 1000 ELSE 0 END AS high_watermark,
         coalesce(top, 0) AS local_change_count, coalesce(n, 0) AS pending_objects
  FROM customer LEFT JOIN tops ON tops.group_id = c_custkey % 4 LEFT JOIN queued ON queued.peer = c_custkey)"""
REPLICATION_STATUS = f"{STATUS_SQL} SELECT *, greatest(local_change_count - high_watermark, 0) AS lag FROM status"
STATUS_TOTALS = f"""{STATUS_SQL} SELECT count(*) AS peers, max(local_change_count) AS local_change_count,
  sum(pending_objects)::BIGINT AS pending_objects FROM status"""

QUERIES = {
    "append_statuses": (append_statuses, APPEND_STATUSES),
    "append_indexed": (append_indexed, APPEND_STATUSES),
    "changes_after_cursor": (changes_after_cursor, CHANGES_AFTER_CURSOR),
    "change_page": (change_page, CHANGE_PAGE),
    "change_page_summary": (change_page_summary, CHANGE_PAGE_SUMMARY),
    "log_pages": (log_pages, LOG_PAGES),
    "log_page_summary": (log_page_summary, LOG_PAGE_SUMMARY),
    "upsert_update": (upsert_update, UPSERT_UPDATE),
    "upsert_versions": (upsert_versions, UPSERT_UPDATE),
    "upsert_nothing": (upsert_nothing, UPSERT_NOTHING),
    "batch_validation": (batch_validation, BATCH_VALIDATION),
    "authorize_changes": (authorize_changes, AUTHORIZE_CHANGES),
    "admit_batch": (admit_batch, ADMIT_BATCH),
    "pull_round": (pull_round, PULL_ROUND),
    "pull_round_state": (pull_round_state, PULL_ROUND_STATE),
    "pull_stream": (pull_stream, PULL_STREAM),
    "page_verdicts": (page_verdicts, PAGE_VERDICTS),
    "next_cursor": (next_cursor, NEXT_CURSOR),
    "advance_watermarks": (advance_watermarks, ADVANCE_WATERMARKS),
    "request_enqueue": (request_enqueue, REQUEST_ENQUEUE),
    "request_pending": (request_pending, REQUEST_PENDING),
    "request_attempts": (request_attempts, REQUEST_ATTEMPTS),
    "request_clear": (request_clear, REQUEST_CLEAR),
    "request_batches": (request_batches, REQUEST_BATCHES),
    "waiting_records": (waiting_records, WAITING_RECORDS),
    "transfer_replay": (transfer_replay, TRANSFER_REPLAY),
    "transfer_hot_key": (transfer_hot_key, TRANSFER_HOT_KEY),
    "transfer_peers": (transfer_peers, TRANSFER_PEERS),
    "transfer_stream": (transfer_stream, TRANSFER_PEERS),
    "transfer_progress": (transfer_progress, TRANSFER_PROGRESS),
    "pull_report_cursors": (pull_report_cursors, PULL_REPORT_CURSORS),
    "sync_report_replay": (sync_report_replay, SYNC_REPORT_REPLAY),
    "serve_report": (serve_report, SERVE_REPORT),
    "pull_report": (pull_report, PULL_REPORT),
    "sync_report": (sync_report, SYNC_REPORT),
    "reference_counts": (reference_counts, REFERENCE_COUNTS),
    "maintained_counts": (maintained_counts, REFERENCE_COUNTS),
    "gc_candidates": (gc_candidates, GC_CANDIDATES),
    "gc_report": (gc_report, GC_REPORT),
    "gc_sweep": (gc_sweep, GC_SWEEP),
    "catalog_audit": (catalog_audit, CATALOG_AUDIT),
    "transfer_audit": (transfer_audit, TRANSFER_AUDIT),
    "member_additions": (member_additions, MEMBER_ADDITIONS),
    "members_after": (members_after, MEMBERS_AFTER),
    "member_revocations": (member_revocations, MEMBER_REVOCATIONS),
    "replication_status": (replication_status, REPLICATION_STATUS),
    "status_totals": (status_totals, STATUS_TOTALS),
}
