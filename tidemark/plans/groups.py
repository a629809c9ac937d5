"""Queries over three groups whose catalogs share content ids, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import changelog, requests, retention
from tidemark.operators import manifests as mf
from tidemark.operators import transfers as tr
from tidemark.plans import fixtures as fx
from tidemark.plans import sql

NOW = 1_700_000_000_000


def objects(spark, sf_dir):
    """Every part in the catalog of two of the three groups; what is readable differs by group."""
    group = F.explode(F.array(*[F.lit(g).cast("bigint") for g in range(3)]))
    rows = fx.objects(spark, sf_dir).withColumn("group_id", group)
    return rows.where("(content_id + group_id) % 3 <> 1").withColumn(
        "available", F.col("available") & ((F.col("content_id") + F.col("group_id")) % 5 != 2)
    )


def refs(spark, sf_dir):
    """References of orders; an order belongs to one group."""
    return fx.refs(spark, sf_dir).withColumn("group_id", F.col("manifest_id") % 3)


SHARED = f"""{sql.REFS}, {sql.OBJECTS},
g_objects AS (
  SELECT group_id, o.content_id, o.kind, o.size, o.verified_at_ms, o.available AND (o.content_id + group_id) % 5 <> 2 AS available
  FROM objects o, (SELECT unnest([0, 1, 2])::BIGINT AS group_id) WHERE (o.content_id + group_id) % 3 <> 1),
g_refs AS (SELECT *, manifest_id % 3 AS group_id FROM refs)"""


def group_missing_chunks(spark, sf_dir):
    return mf.missing_objects(refs(spark, sf_dir), objects(spark, sf_dir), ["manifest_id"])


GROUP_MISSING_CHUNKS = f"""WITH {SHARED}
SELECT DISTINCT group_id, manifest_id, content_id FROM g_refs r
WHERE NOT EXISTS (SELECT 1 FROM g_objects o WHERE o.available AND o.group_id = r.group_id AND o.content_id = r.content_id)"""


def group_dedup_catalog(spark, sf_dir):
    uses = refs(spark, sf_dir).withColumn("kind", F.lit("CHUNK"))
    return mf.dedup_objects(uses, objects(spark, sf_dir), ["manifest_id", "chunk_index"], NOW)


GROUP_DEDUP_CATALOG = f"""WITH {SHARED}, firsts AS (
  SELECT group_id, content_id, count(*) AS n, arg_min(size, (manifest_id, chunk_index)) AS size FROM g_refs GROUP BY group_id, content_id)
SELECT group_id, content_id, 'CHUNK' AS kind,
       CASE WHEN n IS NOT NULL AND NOT coalesce(available, false) THEN f.size ELSE e.size END AS size,
       CASE WHEN n IS NOT NULL THEN {NOW} ELSE verified_at_ms END AS verified_at_ms,
       n IS NOT NULL OR available AS available,
       CASE WHEN n IS NOT NULL AND NOT coalesce(available, false) THEN CAST(1 AS BIGINT) ELSE 0 END AS stored,
       CASE WHEN n IS NULL THEN CAST(0 AS BIGINT) WHEN coalesce(available, false) THEN n ELSE n - 1 END AS reused
FROM g_objects e FULL OUTER JOIN firsts f USING (group_id, content_id)"""


def group_delta_totals(spark, sf_dir):
    return mf.delta_plan(mf.delta_required(refs(spark, sf_dir), objects(spark, sf_dir)))


GROUP_DELTA_TOTALS = f"""WITH {SHARED}, uses AS (
  SELECT group_id, manifest_id, content_id, count(*) AS n, sum(size) AS bytes, min_by(size, chunk_index) AS first_size
  FROM g_refs GROUP BY ALL),
flagged AS (
  SELECT u.*, o.content_id IS NULL AS required FROM uses u
  LEFT JOIN g_objects o ON o.available AND o.group_id = u.group_id AND o.content_id = u.content_id)
SELECT group_id, manifest_id, count_if(required)::BIGINT AS required_chunks, sum(n - required::INT)::BIGINT AS reused_chunks,
       sum(bytes - CASE WHEN required THEN first_size ELSE 0 END)::BIGINT AS reused_bytes,
       sum(CASE WHEN required THEN first_size ELSE 0 END)::BIGINT AS transfer_bytes, count_if(required) = 0 AS is_complete
FROM flagged GROUP BY group_id, manifest_id"""


def _pins(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("group_id"), (F.col("o_orderkey") % 500).alias("content_id"), "o_orderkey"
    )
    edges = refs(spark, sf_dir).select("group_id", F.col("manifest_id").alias("owner_id"), "content_id")
    return orders.where("o_orderkey % 4 = 0"), orders.where("o_orderkey % 3 = 1"), edges


PINS = """changes AS (SELECT o_custkey % 3 AS group_id, o_orderkey % 500 AS content_id FROM orders WHERE o_orderkey % 4 = 0),
heads AS (SELECT o_custkey % 3 AS group_id, o_orderkey % 500 AS content_id FROM orders WHERE o_orderkey % 3 = 1),
edges AS (SELECT DISTINCT group_id, manifest_id, content_id FROM g_refs)"""


def group_reference_counts(spark, sf_dir):
    changes, heads, edges = _pins(spark, sf_dir)
    counted = retention.reference_counts(objects(spark, sf_dir), changes=changes, heads=heads, edges=edges)
    return counted.select("group_id", "content_id", "reference_count")


GROUP_REFERENCE_COUNTS = f"""WITH {SHARED}, {PINS}, pins AS (
  SELECT group_id, content_id FROM changes UNION ALL SELECT * FROM heads UNION ALL SELECT group_id, content_id FROM edges)
SELECT o.group_id, o.content_id, count(p.content_id) AS reference_count
FROM g_objects o LEFT JOIN pins p ON p.group_id = o.group_id AND p.content_id = o.content_id GROUP BY o.group_id, o.content_id"""


def group_gc_sweep(spark, sf_dir):
    """Roots are every fourth order's group and number."""
    changes, _, edges = _pins(spark, sf_dir)
    return retention.gc_sweep(objects(spark, sf_dir), changes, edges).select("group_id", "content_id", "size")


GROUP_GC_SWEEP = f"""WITH {SHARED}, {PINS}, marked AS (
  SELECT group_id, content_id FROM changes
  UNION SELECT e.group_id, e.content_id FROM edges e JOIN changes c ON c.group_id = e.group_id AND c.content_id = e.manifest_id)
SELECT group_id, content_id, size FROM g_objects o
WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.group_id = o.group_id AND m.content_id = o.content_id)"""


def group_append(spark, sf_dir):
    """Orders as changes of three groups; manifests and parts are there in some groups only."""
    key, group = F.col("o_orderkey"), (F.col("o_orderkey") % 3).alias("group_id")
    orders = fx.table(spark, sf_dir, "orders")
    batch = orders.select(
        group, F.concat(F.lit("r"), key).alias("revision_id"), F.concat(F.lit("m"), key).alias("content_id"), key.alias("arrival")
    )
    of_group = F.explode(F.array(*[F.lit(g).cast("bigint") for g in range(3)])).alias("group_id")
    manifests = orders.select(of_group, F.concat(F.lit("m"), key).alias("content_id"), key.alias("k")).where("(k + group_id) % 4 <> 0")
    part = F.col("p_partkey")
    parts = fx.table(spark, sf_dir, "part").select(of_group, F.concat(F.lit("p"), part).alias("content_id"), part.alias("k"))
    catalog = manifests.select("group_id", "content_id", F.lit("MANIFEST").alias("kind"), F.lit(True).alias("available")).unionByName(
        parts.where("(k + group_id) % 50 <> 0").select("group_id", "content_id", F.lit("CHUNK").alias("kind"), F.lit(True).alias("available"))
    )
    lines = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 3).alias("group_id"),
        F.concat(F.lit("m"), "l_orderkey").alias("manifest_id"),
        F.concat(F.lit("p"), "l_partkey").alias("content_id"),
    )
    return changelog.append_changes(batch.where("false").withColumn("sequence", F.lit(0).cast("bigint")), batch, lines, catalog)


GROUP_APPEND = """WITH judged AS (
  SELECT o_orderkey AS k, o_orderkey % 3 AS group_id,
         (o_orderkey + o_orderkey % 3) % 4 = 0 OR EXISTS (
           SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_partkey + l_orderkey % 3) % 50 = 0) AS absent
  FROM orders)
SELECT group_id, 'r' || k AS revision_id, 'm' || k AS content_id, k AS arrival,
       CASE WHEN absent THEN 'OBJECT_NOT_FOUND' ELSE 'COMMITTED' END AS status,
       CASE WHEN NOT absent THEN row_number() OVER (PARTITION BY absent ORDER BY k) END AS sequence
FROM judged"""


def group_requests(spark, sf_dir):
    """Absent chunks of each group, asked from two peers; one group's first requests are queued."""
    absent = group_missing_chunks(spark, sf_dir).select("group_id", "content_id").distinct()
    wanted = absent.withColumn("peer", F.concat(F.lit("p"), F.col("content_id") % 2))
    every = fx.objects(spark, sf_dir).select(F.lit(0).cast("bigint").alias("group_id"), "content_id")
    wanted = wanted.unionByName(every.withColumn("peer", F.lit("p0")))
    queued = wanted.where("group_id = 1 AND content_id % 7 = 0")
    return requests.enqueue(queued, wanted, objects(spark, sf_dir), NOW).select("group_id", "peer", "content_id", "requested_at_ms")


GROUP_REQUESTS = f"""WITH {SHARED}, absent AS (
  SELECT DISTINCT group_id, content_id FROM g_refs r
  WHERE NOT EXISTS (SELECT 1 FROM g_objects o WHERE o.available AND o.group_id = r.group_id AND o.content_id = r.content_id)),
wanted AS (
  SELECT group_id, 'p' || content_id % 2 AS peer, content_id FROM absent UNION SELECT CAST(0 AS BIGINT), 'p0', content_id FROM objects)
SELECT group_id, peer, content_id, CAST({NOW} AS BIGINT) AS requested_at_ms FROM wanted w
WHERE NOT (group_id = 1 AND content_id % 7 = 0)
  AND NOT EXISTS (SELECT 1 FROM g_objects o WHERE o.available AND o.group_id = w.group_id AND o.content_id = w.content_id)"""


def group_transfers(spark, sf_dir):
    """Transfers of one object in two groups: what one group stores is not there for the other."""
    number = F.col("content_id").cast("bigint")
    events = fx.transfer_events(spark, sf_dir).select(
        (number % 2).alias("group_id"),
        F.concat(F.lit("p"), number % 3).alias("peer"),
        F.expr("CAST(CAST(content_id AS BIGINT) div 2 AS STRING)").alias("content_id"),
        *tr.FIELDS,
        "event_id",
    )
    asked = events.where("(CAST(content_id AS BIGINT) * 2 + group_id) % 13 <> 2").select("group_id", "peer", "content_id")
    have = events.where("(CAST(content_id AS BIGINT) * 2 + group_id) % 17 = 5").select("group_id", "content_id", F.lit(True).alias("available"))
    return tr.replay_transfers(events, asked, have).outcomes


_PRESENT = "(object_no % 17 = 5 AND object_no IN (SELECT p_partkey FROM part))"
GROUP_TRANSFERS = f"""WITH RECURSIVE {sql.TRANSFERS.replace(_PRESENT, "object_no % 17 = 5")}
SELECT object_no % 2 AS group_id, 'p' || (object_no % 3) AS peer, CAST(object_no // 2 AS VARCHAR) AS content_id, event_id, op, status, received
FROM fold WHERE rn > 0"""


QUERIES = {
    "group_missing_chunks": (group_missing_chunks, GROUP_MISSING_CHUNKS),
    "group_dedup_catalog": (group_dedup_catalog, GROUP_DEDUP_CATALOG),
    "group_delta_totals": (group_delta_totals, GROUP_DELTA_TOTALS),
    "group_reference_counts": (group_reference_counts, GROUP_REFERENCE_COUNTS),
    "group_gc_sweep": (group_gc_sweep, GROUP_GC_SWEEP),
    "group_append": (group_append, GROUP_APPEND),
    "group_requests": (group_requests, GROUP_REQUESTS),
    "group_transfers": (group_transfers, GROUP_TRANSFERS),
}
