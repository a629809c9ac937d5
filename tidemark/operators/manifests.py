"""Manifests, reassembly, deduplication and delta plans over chunk references.

The working form of a manifest is one row per reference: ``manifest_id, chunk_index,
content_id, size``. Lists are only collected in segments of a fixed number of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import first_status, object_key
from tidemark.functions.paths import path_error
from tidemark.functions.vv import vv_error

# Fixed value: chunks a manifest may list.
MAXIMUM_CHUNKS = 1_000_000
SEGMENT_CHUNKS = 4096
# A row holds no binary value of 2 GiB or more.
MAXIMUM_VALUE = (1 << 31) - 1024
NIL_ID = "0" * 32


def build_manifests(chunks: DataFrame, segment: int = SEGMENT_CHUNKS) -> DataFrame:
    """Ordered chunk lists, one row per manifest and segment of ``segment`` chunks."""
    return (
        chunks.groupBy("manifest_id", F.expr(f"chunk_index div {segment}").alias("segment"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("chunk_index", "content_id", "size"))
            ).alias("chunks"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.sum("size").alias("size"),
        )
    )


def manifest_totals(chunks: DataFrame) -> DataFrame:
    """Chunk count and byte size of each manifest (map-side partial sums)."""
    return chunks.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("size")
    )


def chunk_list_digest(chunks: DataFrame, segment: int = SEGMENT_CHUNKS) -> DataFrame:
    """Digest of each manifest's ordered chunk list, to compare two lists by value.

    A tree of hashes: a list of digests never holds more than ``segment`` chunks or, one
    level up, the segments of one manifest.
    """
    line = F.concat_ws(":", F.col("content_id").cast("string"), F.col("size").cast("string"))
    leaves = chunks.groupBy("manifest_id", F.expr(f"chunk_index div {segment}").alias("s")).agg(
        _ordered_digest(F.col("chunk_index"), line).alias("h")
    )
    inner = leaves.groupBy("manifest_id", F.expr(f"s div {segment}").alias("t")).agg(
        _ordered_digest(F.col("s"), F.col("h")).alias("h")
    )
    return inner.groupBy("manifest_id").agg(
        _ordered_digest(F.col("t"), F.col("h")).alias("chunks_digest")
    )


def _ordered_digest(position: Column, text: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(position.alias("p"), text.alias("h"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), "\n"), 256)


def manifest_errors(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """First failing rule of each manifest, NULL for a valid one.

    ``manifests``: ``manifest_id, file_id, revision_id, size, path, vv``. ``error_index`` is
    the first chunk of size zero where that is the error.
    """
    checks = chunks.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.try_sum("size").alias("_sum"),
        F.min(F.when(F.col("size") == 0, F.col("chunk_index"))).alias("_zero"),
    )
    joined = manifests.join(checks, "manifest_id", "left")
    n = F.coalesce("_n", F.lit(0))
    total = F.when(n == 0, F.lit(0)).otherwise(F.col("_sum"))
    error = F.coalesce(
        first_status(
            (F.col("file_id") == NIL_ID, "NIL_FILE_ID"),
            (F.col("revision_id") == NIL_ID, "NIL_REVISION_ID"),
            (n > MAXIMUM_CHUNKS, "TOO_MANY_CHUNKS"),
            (F.col("_zero").isNotNull(), "ZERO_CHUNK_SIZE"),
            (total.isNull(), "FILE_SIZE_OVERFLOW"),
            (total != F.col("size"), "FILE_SIZE_MISMATCH"),
        ),
        vv_error(F.col("vv"), manifest=True),
        path_error(F.col("path")),
    )
    return joined.withColumn("error", error).withColumn(
        "error_index", F.when(F.col("error") == "ZERO_CHUNK_SIZE", F.col("_zero"))
    ).drop("_n", "_sum", "_zero")


def reassemble(
    manifests: DataFrame,
    refs: DataFrame,
    payloads: DataFrame,
    part_bytes: int = 16 * 1024 * 1024,
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Contents of files from their chunks, in parts, and one status row per file.

    ``manifests``: ``manifest_id, size``. ``payloads``: ``content_id, payload`` once per id.
    ``sizes``: ``content_id, actual``, the payloads' sizes where they are known, so that
    payloads are only read for the parts.
    A part joins the chunks that begin in one stretch of ``part_bytes`` of the file, so no group
    grows with its file. Offsets are running sums over a file's chunk list, ids and sizes only,
    which has at most ``MAXIMUM_CHUNKS`` rows. Statuses
    name the first failing chunk in order: ``MISSING_CHUNK`` or ``CHUNK_SIZE_MISMATCH``,
    then ``FILE_SIZE_MISMATCH``; only ``OK`` files have parts.
    """
    if sizes is None:
        sizes = payloads.select("content_id", F.octet_length("payload").alias("actual"))
    sized = refs.join(sizes.select("content_id", F.col("actual").alias("_actual")), "content_id", "left")
    # Position and kind of a failing chunk in one number, so the aggregate stays hash based.
    failing = F.when(F.col("_actual").isNull(), F.col("chunk_index") * 2).when(
        F.col("_actual") != F.col("size"), F.col("chunk_index") * 2 + 1
    )
    checked = sized.groupBy("manifest_id").agg(
        F.min(failing).alias("_failing"), F.sum("size").alias("_sum")
    )
    status = manifests.join(checked, "manifest_id", "left").select(
        *manifests.columns,
        F.coalesce(
            F.when(F.col("_failing") % 2 == 0, "MISSING_CHUNK").when(
                F.col("_failing") % 2 == 1, "CHUNK_SIZE_MISMATCH"
            ),
            F.when(F.coalesce("_sum", F.lit(0)) != F.col("size"), F.lit("FILE_SIZE_MISMATCH")),
            F.lit("OK"),
        ).alias("status"),
    )
    good = status.where(F.col("status") == "OK").select("manifest_id")
    before = Window.partitionBy("manifest_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(before), F.lit(0))
    parts = (
        refs.join(good, "manifest_id", "left_semi")
        .withColumn("part", (offset / part_bytes).cast("bigint"))
        .join(payloads.select("content_id", "payload"), "content_id")
        .groupBy("manifest_id", "part")
        .agg(F.expr("listagg(payload) WITHIN GROUP (ORDER BY chunk_index)").alias("payload"))
    )
    return parts, status


def reassemble_whole(parts: DataFrame, status: DataFrame, maximum_bytes: int = MAXIMUM_VALUE) -> DataFrame:
    """One value per file. A file larger than a value can be is ``TOO_LARGE`` and stays in parts."""
    too_large = (F.col("status") == "OK") & (F.col("size") > maximum_bytes)
    status = status.withColumn("status", F.when(too_large, "TOO_LARGE").otherwise(F.col("status")))
    small = status.where(F.col("status") == "OK")
    whole = (
        parts.join(small.select("manifest_id"), "manifest_id", "left_semi")
        .groupBy("manifest_id")
        .agg(F.expr("listagg(payload) WITHIN GROUP (ORDER BY part)").alias("payload"))
    )
    empty = F.when((F.col("status") == "OK") & (F.col("size") == 0), F.lit("").cast("binary"))
    return status.join(whole, "manifest_id", "left").withColumn(
        "payload", F.coalesce("payload", empty)
    )


def dedup_objects(chunks: DataFrame, existing: DataFrame, order: list[str], now_ms: int) -> DataFrame:
    """Object catalog after admitting ``chunks``.

    One row per content id. A new id takes kind and size from its first writer in ``order``;
    a known id keeps its row with a fresh ``verified_at_ms`` and is available again. ``stored`` and
    ``reused`` count the admitted occurrences.
    An id that was not available is written anew, with the kind and size of that writer. Where the
    catalog has ``group_id``, an id is one inside its group.
    """
    key = object_key(existing, chunks)
    admitted = chunks.groupBy(*key).agg(
        F.min_by(F.struct("kind", "size"), F.struct(*order)).alias("first"),
        F.count(F.lit(1)).alias("occurrences"),
    )
    known = existing.select(
        *key,
        F.col("kind").alias("_kind"),
        F.col("size").alias("_size"),
        F.col("verified_at_ms").alias("_verified"),
        F.col("available").alias("_available"),
    )
    seen = F.col("occurrences").isNotNull()
    was_usable = F.coalesce("_available", F.lit(False))
    anew = seen & ~was_usable
    return (
        known.join(admitted, key, "full_outer")
        .select(
            *key,
            F.when(anew, F.col("first.kind")).otherwise(F.col("_kind")).alias("kind"),
            F.when(anew, F.col("first.size")).otherwise(F.col("_size")).alias("size"),
            F.when(seen, F.lit(now_ms)).otherwise(F.col("_verified")).alias("verified_at_ms"),
            F.when(seen, F.lit(True)).otherwise(F.col("_available")).alias("available"),
            F.when(seen & ~was_usable, 1).otherwise(0).cast("bigint").alias("stored"),
            F.when(seen, F.col("occurrences") - F.when(was_usable, 0).otherwise(1))
            .otherwise(0)
            .cast("bigint")
            .alias("reused"),
        )
    )


def usable(objects: DataFrame) -> DataFrame:
    return objects.where("available").select(*object_key(objects))


def missing_objects(refs: DataFrame, objects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct referenced ids (per ``by`` and group) that cannot be read now."""
    key = object_key(objects, refs)
    wanted = refs.select(*[c for c in by or [] if c not in key], *key).distinct()
    return wanted.join(usable(objects), key, "left_anti")


def delta_required(refs: DataFrame, objects: DataFrame, plan: str = "manifest_id") -> DataFrame:
    """Per plan and content id: occurrences, bytes, and whether it must be transferred.

    The first occurrence of an absent id is the one to transfer. Grouping by plan and id
    combines map-side, so neither a hot plan nor a popular chunk meets in one task. Where the
    catalog has groups, so has the plan.
    """
    key = object_key(objects, refs)
    uses = refs.groupBy(plan, *key).agg(
        F.min("chunk_index").alias("chunk_index"),
        F.min_by("size", "chunk_index").alias("size"),
        F.count(F.lit(1)).alias("uses"),
        F.sum("size").alias("bytes"),
    )
    have = usable(objects).distinct().withColumn("_have", F.lit(True))
    return uses.join(have, key, "left").select(
        plan,
        *key,
        "chunk_index",
        "size",
        "uses",
        "bytes",
        F.col("_have").isNull().alias("required"),
    )


def delta_plan(required: DataFrame, plan: str = "manifest_id") -> DataFrame:
    """Totals of each plan from ``delta_required``."""
    first = F.when(F.col("required"), F.col("size")).otherwise(F.lit(0))
    return (
        required.groupBy(*(["group_id"] if "group_id" in required.columns else []), plan)
        .agg(
            F.count_if("required").alias("required_chunks"),
            F.sum(F.col("uses") - F.col("required").cast("bigint")).alias("reused_chunks"),
            F.sum(F.col("bytes") - first).alias("reused_bytes"),
            F.sum(first).alias("transfer_bytes"),
        )
        .withColumn("is_complete", F.col("required_chunks") == 0)
    )
