"""Queries over paths, chunks, manifests, delta plans and snapshots, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ids, paths as pt, vv
from tidemark.operators import chunking, diff, integrity, manifests as mf
from tidemark.plans import fixtures as fx
from tidemark.plans import sql
from tidemark.session import checkpoint_ready
from tidemark.sources import files

SMALL = {"minimum": 64, "average": 256, "maximum": 1024}
FOLDER_SIZES = {"minimum": 4096, "average": 16384, "maximum": 65536}
NOW = 1_700_000_000_000

# --- folders ---------------------------------------------------------------------------


def folder_listing(spark, sf_dir):
    """The folder of the tables themselves as a snapshot."""
    return files.list_files(spark, sf_dir).select("path", "length", "path_key", "path_error")


def folder_chunks(spark, sf_dir):
    """Cuts of all files of that folder, each file in blocks of 1 MiB read side by side."""
    return files.chunk_blocks(files.list_files(spark, sf_dir), sf_dir, **FOLDER_SIZES, block=1 << 20)


# --- paths -----------------------------------------------------------------------------


def named_paths(spark, sf_dir):
    return pt.normalize_paths(fx.paths(spark, sf_dir), "path")


def path_normalize(spark, sf_dir):
    return named_paths(spark, sf_dir).select("page_id", "display", "path_key")


PATH_NORMALIZE = f"WITH {sql.PATHS} SELECT page_id, path AS display, lower(path) AS path_key FROM paths"


def path_validate(spark, sf_dir):
    return named_paths(spark, sf_dir).select("page_id", pt.path_error(F.col("display")).alias("error"))


PATH_VALIDATE = f"""WITH {sql.PATHS}, parts AS (
  SELECT page_id, path, unnest(string_split(path, '/')) AS part,
         unnest(range(len(string_split(path, '/')))) AS pos FROM paths),
broken AS (
  SELECT page_id, pos, CASE
    WHEN part = '' THEN 'EMPTY_COMPONENT' WHEN part IN ('.', '..') THEN 'TRAVERSAL'
    WHEN strlen(part) > 255 THEN 'COMPONENT_TOO_LONG'
    WHEN part LIKE '%.' OR part LIKE '% ' THEN 'TRAILING_DOT_OR_SPACE'
    WHEN regexp_full_match(upper(string_split(part, '.')[1]), '(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])') THEN 'RESERVED_NAME'
    WHEN regexp_matches(part, '[\\x00-\\x1f\\x7f<>:"\\\\|?*]') THEN 'FORBIDDEN_CHAR' END AS error
  FROM parts),
first_broken AS (SELECT page_id, min_by(error, pos) AS error FROM broken WHERE error IS NOT NULL GROUP BY page_id)
SELECT page_id, CASE WHEN path = '' THEN 'EMPTY' WHEN path LIKE '/%' OR path LIKE '%/' THEN 'NOT_RELATIVE'
                     ELSE coalesce(error, CASE WHEN strlen(path) > 4096 THEN 'PATH_TOO_LONG' END) END AS error
FROM paths LEFT JOIN first_broken USING (page_id)"""


def path_collisions(spark, sf_dir):
    return diff.path_collisions(named_paths(spark, sf_dir))


PATH_COLLISIONS = f"""WITH {sql.PATHS}
SELECT lower(path) AS path_key, count(*) AS n, min(path) AS first_path, max(path) AS last_path
FROM paths GROUP BY lower(path) HAVING count(*) > 1"""


def path_collision_members(spark, sf_dir):
    return diff.collision_members(named_paths(spark, sf_dir)).select("page_id", "path", "path_key")


PATH_COLLISION_MEMBERS = f"""WITH {sql.PATHS}
SELECT page_id, path, lower(path) AS path_key FROM paths
QUALIFY count(*) OVER (PARTITION BY lower(path)) > 1"""


def path_parts(spark, sf_dir):
    path = F.col("path")
    return fx.paths(spark, sf_dir).select(
        "page_id",
        pt.file_name(path).alias("name"),
        pt.file_stem(path).alias("stem"),
        pt.file_extension(path).alias("extension"),
        pt.parent_path(path).alias("parent"),
    )


_NAME = "string_split(path, '/')[-1]"
PATH_PARTS = f"""WITH {sql.PATHS}, named AS (SELECT *, {_NAME} AS name FROM paths),
cut AS (SELECT *, nullif(regexp_extract(name, '^(.+)\\.([^.]+)$', 1), '') AS s,
               nullif(regexp_extract(name, '^(.+)\\.([^.]+)$', 2), '') AS x FROM named)
SELECT page_id, name, CASE WHEN x IS NULL THEN name ELSE s END AS stem, x AS extension,
       CASE WHEN position('/' IN path) > 0 THEN left(path, length(path) - length(name) - 1) END AS parent
FROM cut"""


def portable_labels(spark, sf_dir):
    label = F.concat(F.lit("  "), F.col("url"), F.when(F.col("page_id") % 3 == 0, ". .").otherwise(""))
    return fx.paths(spark, sf_dir).select("page_id", pt.portable_label(label).alias("label"))


_LABEL = "left(coalesce(nullif(rtrim(trim(regexp_replace({}, '[\\x00-\\x1f\\x7f<>:\"/\\\\|?*]', '_', 'g')), '. '), ''), 'device'), 48)"
PORTABLE_LABELS = f"""WITH {sql.PATHS}
SELECT page_id, {_LABEL.format("concat('  ', url, CASE WHEN page_id % 3 = 0 THEN '. .' ELSE '' END)")} AS label FROM paths"""


def conflict_paths(spark, sf_dir):
    """Conflict names of all files; every tenth stem is too long and is cut."""
    long = F.concat(F.lit("docs/"), F.repeat(F.col("device"), 130), F.lit(".txt"))
    path = F.when(F.col("file_no") % 10 == 0, long).otherwise(F.col("path"))
    copy = pt.conflict_path(path, F.col("device"), F.col("file_no") * 1000, fx.padded("file_no", 32))
    return fx.files(spark, sf_dir).select("file_no", copy.alias("copy"), pt.path_error(copy).alias("error"))


CONFLICT_PATHS = f"""WITH {sql.FILES}, long AS (
  SELECT file_no, device, CASE WHEN file_no % 10 = 0 THEN concat('docs/', repeat(device, 130), '.txt') ELSE path END AS path
  FROM files),
cut AS (SELECT *, {_NAME} AS name, concat(' (conflict ', device, ' ', CAST(file_no * 1000 AS VARCHAR), ' ',
               left(lpad(CAST(file_no AS VARCHAR), 32, '0'), 8), ')') AS suffix FROM long)
SELECT file_no, concat(left(path, length(path) - length(name)),
                       left(left(name, length(name) - 4), 255 - strlen(suffix) - 4), suffix, '.txt') AS copy,
       CAST(NULL AS VARCHAR) AS error FROM cut"""


def content_ids(spark, sf_dir):
    content = F.col("content")
    return fx.files(spark, sf_dir).select(
        "file_no",
        ids.content_id(content, ids.CHUNK, fx.KEY).alias("chunk_id"),
        ids.content_id(content, ids.MANIFEST, fx.KEY).alias("manifest_id"),
        ids.path_id(F.lower("path"), fx.KEY).alias("path_id"),
    )


CONTENT_IDS = f"""WITH {sql.FILES}
SELECT file_no, sha256(concat('{fx.KEY}', 'chunk', chr(0), content)) AS chunk_id,
       sha256(concat('{fx.KEY}', 'manifest', chr(0), content)) AS manifest_id,
       sha256(concat('{fx.KEY}', 'path', chr(0), lower(path))) AS path_id FROM files"""

# --- chunks and manifests -----------------------------------------------------------------


def chunks(spark, sf_dir, payload=True):
    return chunking.cdc_chunk(fx.files(spark, sf_dir), "file_no", "content", key=fx.KEY, payload=payload, **SMALL)


def chunk_invariants(spark, sf_dir):
    """Per document: covered bytes, no gap, size bounds, and an index without holes."""
    rows = chunks(spark, sf_dir)
    total = F.sum("size")
    per_file = rows.groupBy(F.col("id").alias("file_no")).agg(
        total.alias("bytes"),
        (F.sum(F.octet_length("payload")) == total).alias("payload_matches"),
        (F.max(F.col("offset") + F.col("size")) == total).alias("covers"),
        (F.max("size") <= SMALL["maximum"]).alias("below_maximum"),
        (F.count_if(F.col("size") < SMALL["minimum"]) <= 1).alias("above_minimum"),
        (F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("dense"),
    )
    return per_file


CHUNK_INVARIANTS = f"""WITH {sql.FILES}
SELECT file_no, CAST(strlen(content) AS BIGINT) AS bytes, true AS payload_matches, true AS covers,
       true AS below_maximum, true AS above_minimum, true AS dense FROM files WHERE content <> ''"""


def chunk_refs(rows):
    return rows.select(F.col("id").alias("manifest_id"), "chunk_index", "content_id", "size")


def chunk_round_trip(spark, sf_dir):
    """Documents chunked, deduplicated and put together again.

    Ids and sizes are checkpointed, so the texts are cut once for them and once for the payloads.
    """
    checkpoint_ready(spark)
    refs = chunk_refs(chunks(spark, sf_dir, payload=False)).checkpoint()
    stored = chunks(spark, sf_dir).groupBy("content_id").agg(F.min("payload").alias("payload"))
    sizes = refs.groupBy("content_id").agg(F.min("size").alias("actual"))
    files = fx.files(spark, sf_dir).select(
        F.col("file_no").alias("manifest_id"), F.octet_length("content").cast("bigint").alias("size")
    )
    whole = mf.reassemble_whole(*mf.reassemble(files, refs, stored, sizes=sizes))
    return whole.select("manifest_id", "status", F.md5("payload").alias("digest"))


CHUNK_ROUND_TRIP = f"""WITH {sql.FILES}
SELECT file_no AS manifest_id, 'OK' AS status, md5(content) AS digest FROM files"""


def reassemble_conversations(spark, sf_dir):
    parts = fx.parts(spark, sf_dir)
    known = parts.withColumn(
        "content_id", F.concat_ws("-", F.col("manifest_id").cast("string"), F.col("chunk_index").cast("string"))
    ).withColumn("size", F.octet_length("payload").cast("bigint"))
    mark = F.pmod(F.conv(F.substring(F.md5(F.col("manifest_id").cast("string")), 1, 6), 16, 10).cast("bigint"), F.lit(10))
    known = known.withColumn("mark", mark)
    files = known.groupBy("manifest_id", "mark").agg(F.sum("size").alias("size")).select(
        "manifest_id", (F.col("size") + F.when(F.col("mark") == 3, 1).otherwise(0)).alias("size")
    )
    stored = known.where("NOT (mark = 1 AND chunk_index = 1)").select(
        "content_id",
        F.when((F.col("mark") == 2) & (F.col("chunk_index") == 0), F.concat("payload", F.lit("!")))
        .otherwise(F.col("payload"))
        .cast("binary")
        .alias("payload"),
    )
    refs = known.select("manifest_id", "chunk_index", "content_id", "size")
    whole = mf.reassemble_whole(*mf.reassemble(files, refs, stored, part_bytes=200))
    return whole.select("manifest_id", "size", "status", F.md5("payload").alias("digest"))


REASSEMBLE_CONVERSATIONS = """WITH known AS (
  SELECT conv_id AS manifest_id, turn AS chunk_index, text,
         CAST(('0x' || left(md5(CAST(conv_id AS VARCHAR)), 6)) AS BIGINT) % 10 AS mark FROM conversations),
files AS (
  SELECT manifest_id, any_value(mark) AS mark, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
         md5(string_agg(text, '' ORDER BY chunk_index)) AS digest, count_if(chunk_index = 1) AS second,
         count_if(chunk_index = 0) AS zeroth FROM known GROUP BY manifest_id),
judged AS (
  SELECT *, CASE WHEN mark = 1 AND second > 0 THEN 'MISSING_CHUNK'
                 WHEN mark = 2 AND zeroth > 0 THEN 'CHUNK_SIZE_MISMATCH'
                 WHEN mark = 3 THEN 'FILE_SIZE_MISMATCH' ELSE 'OK' END AS status FROM files)
SELECT manifest_id, bytes + CASE WHEN mark = 3 THEN 1 ELSE 0 END AS size, status,
       CASE WHEN status = 'OK' THEN digest END AS digest FROM judged"""


def manifest_lists(spark, sf_dir):
    """Ordered chunk lists of all orders, in segments of four chunks."""
    line = F.array_join(
        F.transform("chunks", lambda c: F.concat_ws(":", c["content_id"].cast("string"), c["size"].cast("string"))), ","
    )
    built = mf.build_manifests(fx.refs(spark, sf_dir), segment=4)
    return built.select("manifest_id", "segment", line.alias("chunks"), "n_chunks", "size")


MANIFEST_LISTS = f"""WITH {sql.REFS}
SELECT manifest_id, CAST(floor(chunk_index / 4) AS BIGINT) AS segment,
       string_agg(content_id || ':' || size, ',' ORDER BY chunk_index) AS chunks, count(*) AS n_chunks,
       CAST(sum(size) AS BIGINT) AS size
FROM refs GROUP BY manifest_id, floor(chunk_index / 4)"""


def chunk_list_digests(spark, sf_dir):
    return mf.chunk_list_digest(fx.refs(spark, sf_dir), segment=4)


CHUNK_LIST_DIGESTS = f"""WITH {sql.REFS}, leaves AS (
  SELECT manifest_id, floor(chunk_index / 4) AS s,
         sha256(string_agg(content_id || ':' || size, chr(10) ORDER BY chunk_index)) AS h
  FROM refs GROUP BY manifest_id, floor(chunk_index / 4)),
inside AS (SELECT manifest_id, floor(s / 4) AS t, sha256(string_agg(h, chr(10) ORDER BY s)) AS h
           FROM leaves GROUP BY manifest_id, floor(s / 4))
SELECT manifest_id, sha256(string_agg(h, chr(10) ORDER BY t)) AS chunks_digest FROM inside GROUP BY manifest_id"""


def manifest_validate(spark, sf_dir):
    """Orders as manifests with one rule broken in some of them."""
    refs = fx.refs(spark, sf_dir)
    broken = refs.withColumn(
        "size", F.when((F.col("manifest_id") % 7 == 1) & (F.col("chunk_index") == 1), 0).otherwise(F.col("size"))
    )
    key = F.col("manifest_id")
    heads = mf.manifest_totals(refs).select(
        "manifest_id",
        F.when(key % 31 == 0, mf.NIL_ID).otherwise(fx.padded("manifest_id", 32)).alias("file_id"),
        F.when(key % 37 == 1, mf.NIL_ID).otherwise(F.lpad(key.cast("string"), 32, "5")).alias("revision_id"),
        (F.col("size") + F.when(key % 11 == 2, 1).otherwise(0)).alias("size"),
        F.when(key % 13 == 3, F.array().cast(vv.VV_TYPE))
        .when(key % 13 == 4, F.array(vv.vv_entry(F.lit("b"), F.lit(1)), vv.vv_entry(F.lit("a"), F.lit(1))))
        .when(key % 13 == 5, F.array(vv.vv_entry(F.lit("a"), F.lit(0))))
        .otherwise(F.array(vv.vv_entry(F.lit("a"), F.lit(1))))
        .alias("vv"),
        F.when(key % 17 == 6, F.lit("a/../b")).otherwise(F.lit("a/b")).alias("path"),
    )
    return mf.manifest_errors(heads, broken).select("manifest_id", "error", "error_index")


MANIFEST_VALIDATE = f"""WITH {sql.REFS}, sized AS (
  SELECT manifest_id, count_if(chunk_index = 1) AS second,
         sum(CASE WHEN chunk_index = 1 THEN size ELSE 0 END) AS second_size FROM refs GROUP BY manifest_id),
judged AS (
  SELECT manifest_id AS k, CASE
    WHEN manifest_id = 0 OR manifest_id % 31 = 0 THEN 'NIL_FILE_ID' WHEN manifest_id % 37 = 1 THEN 'NIL_REVISION_ID'
    WHEN manifest_id % 7 = 1 AND second > 0 THEN 'ZERO_CHUNK_SIZE'
    WHEN manifest_id % 11 = 2 THEN 'FILE_SIZE_MISMATCH'
    WHEN manifest_id % 13 = 3 THEN 'EMPTY' WHEN manifest_id % 13 = 4 THEN 'NOT_STRICTLY_SORTED'
    WHEN manifest_id % 13 = 5 THEN 'ZERO_COUNTER' WHEN manifest_id % 17 = 6 THEN 'TRAVERSAL' END AS error FROM sized)
SELECT k AS manifest_id, error, CASE WHEN error = 'ZERO_CHUNK_SIZE' THEN CAST(1 AS BIGINT) END AS error_index FROM judged"""


def chunk_uses(spark, sf_dir):
    return fx.refs(spark, sf_dir).withColumn("kind", F.lit("CHUNK"))


def dedup_catalog(spark, sf_dir):
    """The catalog after admitting all references of orders; every seventh part is new to it."""
    existing = fx.objects(spark, sf_dir).where("content_id % 7 <> 0")
    out = mf.dedup_objects(chunk_uses(spark, sf_dir), existing, ["manifest_id", "chunk_index"], NOW)
    return out


DEDUP_CATALOG = f"""WITH {sql.REFS}, {sql.OBJECTS}, existing AS (SELECT * FROM objects WHERE content_id % 7 <> 0),
firsts AS (
  SELECT content_id, count(*) AS n, arg_min(size, (manifest_id, chunk_index)) AS size FROM refs GROUP BY content_id)
SELECT content_id, 'CHUNK' AS kind,
       CASE WHEN f.n IS NOT NULL AND NOT coalesce(available, false) THEN f.size ELSE e.size END AS size,
       CASE WHEN f.n IS NOT NULL THEN {NOW} ELSE verified_at_ms END AS verified_at_ms,
       CASE WHEN f.n IS NOT NULL THEN true ELSE available END AS available,
       CASE WHEN f.n IS NOT NULL AND NOT coalesce(available, false) THEN CAST(1 AS BIGINT) ELSE 0 END AS stored,
       CASE WHEN f.n IS NULL THEN CAST(0 AS BIGINT) WHEN coalesce(available, false) THEN n ELSE n - 1 END AS reused
FROM existing e FULL OUTER JOIN firsts f USING (content_id)"""


def missing_chunks(spark, sf_dir):
    return mf.missing_objects(fx.refs(spark, sf_dir), fx.objects(spark, sf_dir), ["manifest_id"])


MISSING_CHUNKS = f"""WITH {sql.REFS}, {sql.OBJECTS}
SELECT DISTINCT manifest_id, content_id FROM refs
WHERE content_id NOT IN (SELECT content_id FROM objects WHERE available)"""


def delta_required(spark, sf_dir):
    required = mf.delta_required(fx.refs(spark, sf_dir), fx.objects(spark, sf_dir))
    return required.where("required").select("manifest_id", "content_id", "chunk_index", "size")


_FLAGGED = f"""WITH {sql.REFS}, {sql.OBJECTS}, flagged AS (
  SELECT r.*, o.content_id IS NULL AND row_number() OVER (
           PARTITION BY manifest_id, r.content_id ORDER BY chunk_index) = 1 AS required
  FROM refs r LEFT JOIN (SELECT content_id FROM objects WHERE available) o USING (content_id))"""
DELTA_REQUIRED = f"{_FLAGGED} SELECT manifest_id, content_id, chunk_index, size FROM flagged WHERE required"


def delta_totals(spark, sf_dir):
    return mf.delta_plan(mf.delta_required(fx.refs(spark, sf_dir), fx.objects(spark, sf_dir)))


DELTA_TOTALS = f"""{_FLAGGED}
SELECT manifest_id, count_if(required)::BIGINT AS required_chunks, count_if(NOT required)::BIGINT AS reused_chunks,
       sum(CASE WHEN required THEN 0 ELSE size END)::BIGINT AS reused_bytes,
       sum(CASE WHEN required THEN size ELSE 0 END)::BIGINT AS transfer_bytes, count_if(required) = 0 AS is_complete
FROM flagged GROUP BY manifest_id"""


def sealed(spark, sf_dir):
    """Documents sealed and then tampered with in several ways."""
    group, kind = F.lit("g1"), F.when(F.col("file_no") % 4 == 0, "MANIFEST").otherwise("CHUNK")
    envelopes = integrity.seal(fx.files(spark, sf_dir).select("file_no", "content"), "content", group, kind, "0123456789abcdef", fx.KEY)
    n = F.col("file_no")
    return (
        envelopes.withColumn("asked_kind", F.when(n % 11 == 1, "OTHER").otherwise(F.col("kind")))
        .withColumn("asked_id", F.when(n % 13 == 2, F.repeat(F.lit("0"), 64)).otherwise(F.col("content_id")))
        .withColumn("version", F.when(n % 23 == 5, 2).otherwise(F.col("version")))
        .withColumn(
            "ciphertext",
            F.when(n % 17 == 3, F.concat("ciphertext", F.lit("x").cast("binary"))).otherwise(F.col("ciphertext")),
        )
        .withColumn("group_id", F.when(n % 19 == 4, "g2").otherwise("g1"))
    )


def sealed_object_audit(spark, sf_dir):
    audit = integrity.verify_objects(
        sealed(spark, sf_dir), F.col("group_id"), F.col("asked_kind"), F.col("asked_id"), "0123456789abcdef", fx.KEY
    )
    return audit.select("file_no", "status", "available")


SEALED_OBJECT_AUDIT = f"""WITH {sql.FILES}, judged AS (
  SELECT file_no, CASE WHEN file_no % 23 = 5 THEN 'BAD_VERSION' WHEN file_no % 11 = 1 THEN 'BAD_KIND'
                       WHEN file_no % 13 = 2 THEN 'BAD_ID'
                       WHEN file_no % 17 = 3 OR file_no % 19 = 4 THEN 'AUTH_FAILED' ELSE 'OK' END AS status FROM files)
SELECT file_no, status, status = 'OK' AS available FROM judged"""

# --- snapshots -----------------------------------------------------------------------------


def orders_diff(spark, sf_dir):
    return diff.snapshot_diff(fx.heads(spark, sf_dir), fx.listing(spark, sf_dir), "m", NOW, fx.KEY)


def snapshot_diff(spark, sf_dir):
    return orders_diff(spark, sf_dir).withColumn("vv", vv.vv_text(F.col("vv")))


def _new_id(domain: str) -> str:
    digest = f"sha256(concat('{fx.KEY}', '{domain}', chr(0), 'm', chr(0), path_id, chr(0), '{NOW}'))"
    return (
        f"concat({digest}[1:12], '5', {digest}[14:16], translate({digest}[17:17], '0123456789abcdef', "
        f"'89ab89ab89ab89ab'), {digest}[18:32])"
    )


SNAPSHOT_DIFF = f"""WITH {sql.DIFF}
SELECT path_id, change, CASE WHEN change = 'MODIFIED' THEN why END AS reason,
       CASE WHEN change = 'DELETED' THEN 'TOMBSTONE' ELSE 'FILE' END AS kind,
       coalesce(was_file_id, {_new_id("new-file")}) AS file_id,
       CASE WHEN change <> 'UNCHANGED' THEN {_new_id("new-revision")} END AS revision_id,
       coalesce(display, was_display) AS display, size,
       CASE WHEN change = 'DELETED' THEN {NOW} ELSE CAST(mtime_ms AS BIGINT) END AS mtime_ms, chunks_digest,
       CASE WHEN change = 'NEW' THEN 'm:1'
            ELSE 'a:' || a_c || ',m:' || CASE WHEN change = 'UNCHANGED' THEN m_c ELSE m_c + 1 END END AS vv
FROM diff WHERE change IS NOT NULL"""


def scan_report(spark, sf_dir):
    return diff.scan_report(orders_diff(spark, sf_dir), fx.refs(spark, sf_dir), fx.objects(spark, sf_dir))


SCAN_REPORT = f"""WITH {sql.DIFF}, {sql.REFS}, {sql.OBJECTS},
f AS (SELECT count_if(change IN ('NEW', 'MODIFIED', 'RESTORED', 'UNCHANGED')) AS files_discovered,
             count_if(change IN ('NEW', 'MODIFIED', 'RESTORED')) AS file_changes,
             count_if(change = 'UNCHANGED') AS files_unchanged,
             count_if(change = 'DELETED') AS tombstones_created FROM diff),
c AS (SELECT count(DISTINCT content_id) FILTER (NOT coalesce(o.available, false)) AS chunks_stored, count(*) AS n,
             sum(r.size) AS plaintext_bytes FROM refs r LEFT JOIN objects o USING (content_id))
SELECT files_discovered::BIGINT AS files_discovered, file_changes::BIGINT AS file_changes,
       files_unchanged::BIGINT AS files_unchanged, tombstones_created::BIGINT AS tombstones_created,
       chunks_stored::BIGINT AS chunks_stored, (n - chunks_stored)::BIGINT AS chunks_reused,
       plaintext_bytes::BIGINT AS plaintext_bytes, (file_changes + tombstones_created)::BIGINT AS changes_committed
FROM f, c"""


def gate_violations(spark, sf_dir):
    """All reasons at once: a revoked author, pending rows, bad paths and collisions."""
    listing = named_paths(spark, sf_dir).withColumn("path_error", pt.path_error(F.col("display")))
    members = fx.members(spark, sf_dir)
    me = members.where("status = 'REVOKED'").agg(F.min("device")).scalar()
    pending = fx.heads(spark, sf_dir).where("path_id % 100 = 1")
    gate = diff.diff_gate(members.withColumn("device", F.when(F.col("device") == me, -1).otherwise(F.col("device"))), -1, pending, listing)
    return gate


GATE_VIOLATIONS = f"""WITH {sql.HEADS}, validated AS ({PATH_VALIDATE})
SELECT 'REVOKED' AS violation, CAST(1 AS BIGINT) AS n
UNION ALL SELECT 'PENDING_MATERIALIZATION', count(*) FROM heads WHERE path_id % 100 = 1
UNION ALL SELECT 'INVALID_PATH', count(*) FROM validated WHERE error IS NOT NULL
UNION ALL SELECT 'PATH_COLLISION', count(*) FROM ({PATH_COLLISIONS})"""


def gated_deletions(spark, sf_dir):
    """Deletions of a diff whose listing is clean: the gate lets them through."""
    members = fx.members(spark, sf_dir)
    listing = fx.files(spark, sf_dir).withColumn("path_key", F.lower("path")).withColumn(
        "path_error", pt.path_error(F.col("path"))
    )
    me = members.where("status = 'ACTIVE'").withColumn("device", F.lit(-1))
    gate = diff.diff_gate(me, -1, fx.heads(spark, sf_dir).where("path_id < 0"), listing)
    return diff.gated(orders_diff(spark, sf_dir), gate).where("change = 'DELETED'").select("path_id", "kind", "mtime_ms")


GATED_DELETIONS = f"""WITH {sql.DIFF}
SELECT path_id, 'TOMBSTONE' AS kind, {NOW} AS mtime_ms FROM diff WHERE change = 'DELETED'"""

QUERIES = {
    # A file listing and file bytes are not tables of the SQL check; tests compare with the folder itself.
    "folder_listing": (folder_listing, None),
    "folder_chunks": (folder_chunks, None),
    "path_normalize": (path_normalize, PATH_NORMALIZE),
    "path_validate": (path_validate, PATH_VALIDATE),
    "path_collisions": (path_collisions, PATH_COLLISIONS),
    "path_collision_members": (path_collision_members, PATH_COLLISION_MEMBERS),
    "path_parts": (path_parts, PATH_PARTS),
    "portable_labels": (portable_labels, PORTABLE_LABELS),
    "conflict_paths": (conflict_paths, CONFLICT_PATHS),
    "content_ids": (content_ids, CONTENT_IDS),
    "chunk_invariants": (chunk_invariants, CHUNK_INVARIANTS),
    "chunk_round_trip": (chunk_round_trip, CHUNK_ROUND_TRIP),
    "reassemble_conversations": (reassemble_conversations, REASSEMBLE_CONVERSATIONS),
    "manifest_lists": (manifest_lists, MANIFEST_LISTS),
    "chunk_list_digests": (chunk_list_digests, CHUNK_LIST_DIGESTS),
    "manifest_validate": (manifest_validate, MANIFEST_VALIDATE),
    "dedup_catalog": (dedup_catalog, DEDUP_CATALOG),
    "missing_chunks": (missing_chunks, MISSING_CHUNKS),
    "delta_required": (delta_required, DELTA_REQUIRED),
    "delta_totals": (delta_totals, DELTA_TOTALS),
    "sealed_object_audit": (sealed_object_audit, SEALED_OBJECT_AUDIT),
    "snapshot_diff": (snapshot_diff, SNAPSHOT_DIFF),
    "scan_report": (scan_report, SCAN_REPORT),
    "gate_violations": (gate_violations, GATE_VIOLATIONS),
    "gated_deletions": (gated_deletions, GATED_DELETIONS),
}
