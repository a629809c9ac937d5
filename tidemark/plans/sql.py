"""SQL text shared by the checks: the fixtures and the vector rules."""

FILES = """files AS (
  SELECT doc_id AS file_no,
         concat(source, '/', lang, '/doc-', CAST(doc_id AS VARCHAR), '.txt') AS path,
         text AS content, concat('d', CAST(doc_id % 5 AS VARCHAR)) AS device
  FROM documents)"""

CHANGES = """e AS (
  SELECT event_id + 1 AS sequence, CAST(user_id AS VARCHAR) AS path_id, event_type AS author,
         CAST(floor(event_id / 500.0) AS BIGINT) AS epoch,
         CASE WHEN event_id % 7 = 0 THEN 'TOMBSTONE' ELSE 'FILE' END AS kind,
         lpad(CAST(event_id AS VARCHAR), 12, '0') AS revision_id
  FROM events),
own AS (SELECT *, count(*) OVER (PARTITION BY path_id, author ORDER BY sequence) AS own_c FROM e),
per AS (SELECT path_id, author, epoch, count(*) AS n FROM e GROUP BY path_id, author, epoch),
known AS (
  SELECT b.path_id, b.epoch, p.author AS d, CAST(sum(p.n) AS BIGINT) AS c
  FROM (SELECT DISTINCT path_id, epoch FROM e) b
  JOIN per p ON p.path_id = b.path_id AND p.epoch < b.epoch
  GROUP BY b.path_id, b.epoch, p.author),
entries AS (
  SELECT o.sequence, k.d, k.c FROM own o JOIN known k
    ON k.path_id = o.path_id AND k.epoch = o.epoch AND k.d <> o.author
  UNION ALL SELECT sequence, author, own_c FROM own),
vvs AS (
  SELECT sequence, list(struct_pack(d := d, c := c) ORDER BY d) AS vv,
         string_agg(d || ':' || c, ',' ORDER BY d) AS vv_text
  FROM entries GROUP BY sequence),
changes AS (
  SELECT e.sequence, path_id, path_id AS file_id, revision_id, kind, author, vv, vv_text,
         'r' || revision_id AS content_id
  FROM e JOIN vvs USING (sequence)),
paired AS (
  SELECT *, lag(revision_id) OVER w AS l_rev, lag(kind) OVER w AS l_kind, lag(vv) OVER w AS l_vv,
         lag(sequence) OVER w AS l_seq
  FROM changes WINDOW w AS (PARTITION BY path_id ORDER BY sequence))"""

REFS = """refs AS (
  SELECT l_orderkey AS manifest_id, l_partkey AS content_id, CAST(l_quantity AS BIGINT) AS size,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_quantity, l_extendedprice, l_shipdate) - 1 AS chunk_index
  FROM lineitem)"""

OBJECTS = """objects AS (
  SELECT p_partkey AS content_id, 'CHUNK' AS kind, CAST(p_size AS BIGINT) AS size,
         1000000 + (p_partkey * 7919) % 86400000 AS verified_at_ms, p_partkey % 10 <> 0 AS available
  FROM part)"""

MEMBERS = """members AS (
  SELECT c_custkey AS device, 1 AS group_id, concat('key-', CAST(c_custkey AS VARCHAR)) AS tag_key,
         CASE WHEN c_custkey % 25 = 0 THEN 'OWNER' ELSE 'MEMBER' END AS role,
         CASE WHEN c_acctbal < 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
         CASE WHEN c_acctbal < 0 THEN 5 END AS revoked_at_ms
  FROM customer WHERE c_custkey % 20 <> 3)"""

HEADS = """heads AS (
  SELECT o_orderkey AS path_id, CASE WHEN o_orderkey % 19 = 0 THEN 'TOMBSTONE' ELSE 'FILE' END AS kind,
         'f' || o_orderkey AS file_id, o_orderkey % 5 + 1 AS a_c, o_custkey % 3 + 1 AS m_c,
         o_orderpriority AS display, CAST(round(o_totalprice * 100) AS BIGINT) AS size,
         1000 AS mtime_ms, 'c' || (o_custkey % 7) AS chunks_digest
  FROM orders WHERE o_orderkey % 11 <> 0)"""

LISTING = """listing AS (
  SELECT o_orderkey AS path_id,
         CASE WHEN o_orderkey % 23 = 0 THEN upper(concat(o_orderpriority, 'x')) ELSE o_orderpriority END AS display,
         CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS size,
         1000 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS mtime_ms,
         'c' || (o_custkey % 7) AS chunks_digest
  FROM orders WHERE o_orderkey % 13 <> 0)"""

DIFF = f"""{HEADS}, {LISTING},
diff AS (
  SELECT path_id, h.kind AS was_kind, h.file_id AS was_file_id, h.a_c, h.m_c,
         l.display, l.size, l.mtime_ms, l.chunks_digest, h.display AS was_display,
         CASE WHEN h.kind IS NULL THEN 'NEW'
              WHEN l.size IS NOT NULL AND h.kind = 'TOMBSTONE' THEN 'RESTORED'
              WHEN l.size IS NOT NULL AND l.display = h.display AND l.size = h.size
                   AND l.mtime_ms = h.mtime_ms AND l.chunks_digest = h.chunks_digest THEN 'UNCHANGED'
              WHEN l.size IS NOT NULL THEN 'MODIFIED'
              WHEN h.kind = 'FILE' THEN 'DELETED' END AS change,
         CASE WHEN l.size <> h.size OR l.chunks_digest <> h.chunks_digest THEN 'CONTENT'
              WHEN l.display <> h.display THEN 'CASE_RENAME' ELSE 'TOUCH' END AS why
  FROM heads h FULL OUTER JOIN listing l USING (path_id))"""

PATHS = """paths AS (
  SELECT page_id, url, CASE page_id % 8
           WHEN 0 THEN concat('/', regexp_replace(url, '^https?://', ''))
           WHEN 1 THEN replace(regexp_replace(url, '^https?://', ''), '/', '//')
           WHEN 2 THEN concat('a/../', CAST(page_id AS VARCHAR))
           WHEN 3 THEN concat('docs/CON.', CAST(page_id AS VARCHAR))
           WHEN 4 THEN concat('docs/name', CAST(page_id AS VARCHAR), '.')
           WHEN 5 THEN upper(concat('docs/f', CAST(page_id % 40 AS VARCHAR), '.txt'))
           WHEN 6 THEN concat('docs/f', CAST(page_id % 40 - 1 AS VARCHAR), '.txt')
           ELSE regexp_replace(url, '^https?://', '') END AS path
  FROM pages)"""

TRANSFER_OPS = """ev AS (
  SELECT event_id, user_id AS object_no, CAST(floor(value * 10) AS BIGINT) + 1 AS len FROM events),
offs AS (
  SELECT *, CASE WHEN event_id % 9 <> 0 THEN coalesce(sum(CASE WHEN event_id % 9 <> 0 THEN len ELSE 0 END) OVER (
      PARTITION BY object_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      ELSE 0 END AS off FROM ev),
totals AS (
  SELECT object_no, min(event_id) AS first, max(event_id) AS last,
         CAST(sum(CASE WHEN event_id % 9 <> 0 THEN len ELSE 0 END) AS BIGINT) AS size
  FROM ev GROUP BY object_no),
ops AS (
  SELECT object_no, event_id * 2 + 1 AS event_id, 'APPEND' AS op, NULL AS request_id,
         NULL AS size, CAST(off AS BIGINT) AS start_offset, len FROM offs
  UNION ALL
  SELECT object_no, first * 2, 'BEGIN',
         CASE WHEN object_no % 31 = 0 THEN repeat('0', 32) ELSE lpad(CAST(object_no AS VARCHAR), 32, '7') END,
         size, NULL, NULL FROM totals
  UNION ALL
  SELECT object_no, last * 2 + 2, CASE WHEN object_no % 10 = 4 THEN 'CANCEL' ELSE 'COMPLETE' END,
         NULL, NULL, NULL, NULL FROM totals)"""

# Steps through the rows of ``ops``, with ``totals`` naming the transfers.
TRANSFER_FOLD = """numbered AS (
  SELECT *, 'p' || (object_no % 3) AS peer, row_number() OVER (PARTITION BY object_no ORDER BY event_id) AS rn
  FROM ops),
fold AS (
  SELECT object_no, 0 AS rn, false AS is_open, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS received,
         (object_no % 17 = 5 AND object_no IN (SELECT p_partkey FROM part)) AS present,
         object_no % 13 <> 2 AS requested, CAST(NULL AS BIGINT) AS event_id,
         CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS status
  FROM totals
  UNION ALL
  SELECT object_no, rn,
         (is_open OR st = 'START') AND st NOT IN ('STORED', 'CANCELLED'),
         CASE WHEN st = 'START' THEN e_size WHEN st NOT IN ('STORED', 'CANCELLED') THEN size END,
         CASE WHEN st = 'START' THEN 0 WHEN st = 'ACCEPTED' THEN received + len
              WHEN st NOT IN ('STORED', 'CANCELLED') THEN received END,
         present OR st = 'STORED', requested AND st <> 'STORED', event_id, op, st
  FROM (
    SELECT f.object_no, n.rn, f.is_open, f.size, f.received, f.present, f.requested, n.event_id, n.op,
           n.len, n.size AS e_size,
           CASE WHEN n.op = 'BEGIN' THEN
                  CASE WHEN n.request_id = repeat('0', 32) THEN 'NIL_REQUEST'
                       WHEN n.size < 1 OR n.size > 67108864 THEN 'SIZE_OUT_OF_RANGE'
                       WHEN f.present THEN 'ALREADY_PRESENT'
                       WHEN NOT f.requested THEN 'NOT_REQUESTED'
                       WHEN f.is_open AND f.size <> n.size THEN 'SIZE_MISMATCH'
                       WHEN f.is_open THEN 'RESUME' ELSE 'START' END
                WHEN n.op = 'APPEND' THEN
                  CASE WHEN NOT f.is_open THEN 'NOT_FOUND'
                       WHEN n.start_offset <> f.received THEN 'OFFSET_MISMATCH'
                       WHEN n.len = 0 THEN 'NOOP'
                       WHEN f.received + n.len > f.size THEN 'EXCEEDS_SIZE' ELSE 'ACCEPTED' END
                WHEN n.op = 'COMPLETE' THEN
                  CASE WHEN NOT f.is_open THEN 'NOT_FOUND'
                       WHEN f.received <> f.size THEN 'INCOMPLETE' ELSE 'STORED' END
                ELSE CASE WHEN f.is_open THEN 'CANCELLED' ELSE 'NOTHING_TO_CANCEL' END END AS st
    FROM fold f JOIN numbered n ON n.object_no = f.object_no AND n.rn = f.rn + 1))"""

TRANSFERS = f"{TRANSFER_OPS},\n{TRANSFER_FOLD}"


def ahead(a: str, b: str) -> str:
    """``a`` holds a counter above the one in ``b``."""
    return (
        f"len(list_filter({a}, lambda x: x.c > coalesce(list_filter({b}, lambda y: y.d = x.d)[1].c, 0))) > 0"
    )


def relation(a: str, b: str) -> str:
    return (
        f"CASE WHEN {ahead(a, b)} AND {ahead(b, a)} THEN 'CONCURRENT' "
        f"WHEN {ahead(a, b)} THEN 'DESCENDANT' WHEN {ahead(b, a)} THEN 'ANCESTOR' ELSE 'EQUAL' END"
    )


def text(vv: str) -> str:
    return f"array_to_string(list_transform({vv}, lambda x: x.d || ':' || x.c), ',')"


def decision(rel: str, l_rev: str, l_kind: str, l_vv: str, i_rev: str, i_kind: str, i_vv: str) -> dict[str, str]:
    """Action and kept revisions, as SQL, for records of one file."""
    wins = f"(({l_vv}) > ({i_vv}) OR (({l_vv}) = ({i_vv}) AND {l_rev} >= {i_rev}))"
    open_both = f"({rel} NOT IN ('ANCESTOR', 'DESCENDANT') AND {l_kind} = 'FILE' AND {i_kind} = 'FILE' AND {l_rev} <> {i_rev})"
    action = (
        f"CASE WHEN {l_rev} IS NULL THEN 'USE_INCOMING' WHEN {l_rev} = {i_rev} THEN 'NO_CHANGE' "
        f"WHEN {rel} = 'ANCESTOR' THEN 'USE_INCOMING' WHEN {rel} = 'DESCENDANT' THEN 'KEEP_LOCAL' "
        f"WHEN {open_both} THEN 'KEEP_BOTH' WHEN {l_kind} = 'FILE' THEN 'KEEP_LOCAL' "
        f"WHEN {i_kind} = 'FILE' THEN 'USE_INCOMING' WHEN {wins} THEN 'KEEP_LOCAL' ELSE 'USE_INCOMING' END"
    )
    return {
        "action": action,
        "canonical": f"CASE WHEN {open_both} THEN CASE WHEN {wins} THEN {l_rev} ELSE {i_rev} END END",
        "conflict": f"CASE WHEN {open_both} THEN CASE WHEN {wins} THEN {i_rev} ELSE {l_rev} END END",
    }
