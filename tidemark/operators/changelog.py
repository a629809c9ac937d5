"""Append-only change log: idempotent append, cursors and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import first_status, object_key
from tidemark.operators.ranking import dense_rank
from tidemark.session import materialized
from tidemark.sources.keyed import BUCKETS, KeyedTable, Manifest


def read_changes(log: DataFrame, group: int | str, after: int) -> DataFrame:
    """Rows of one group past a cursor; both predicates reach the parquet scan."""
    return log.where((F.col("group_id") == group) & (F.col("sequence") > after))


def _object_problem(kind: str) -> Column:
    return first_status(
        (F.col("_kind").isNull(), "OBJECT_NOT_FOUND"),
        (F.col("_kind") != kind, "OBJECT_KIND_MISMATCH"),
    )


def chunk_problems(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Manifests (``content_id``) with a chunk that cannot be used: ``_chunk``, the first problem in id order, and
    ``_absent``, whether some chunk is not there at all.

    References meet the objects before they are grouped, so only those with a problem are shuffled again.
    """
    key = object_key(objects, refs)
    group = key[:-1]
    ready = objects.where("available").select(*key, F.col("kind").alias("_kind"))
    return (
        refs.select(*group, "manifest_id", "content_id")
        .join(ready, key, "left")
        .withColumn("_problem", _object_problem("CHUNK"))
        .where(F.col("_problem").isNotNull())
        .groupBy(*group, F.col("manifest_id").alias("content_id"))
        .agg(F.min_by("_problem", "content_id").alias("_chunk"), F.max(F.col("_kind").isNull()).alias("_absent"))
    )


def with_object_problem(
    batch: DataFrame, refs: DataFrame, objects: DataFrame, check_manifests: bool = True
) -> DataFrame:
    """Add ``problem``: what keeps a change from being committed (NULL: nothing).

    The manifest itself comes first, then its chunks in id order; listing a chunk twice
    changes nothing. References of other manifests in ``refs`` are left out first.
    ``check_manifests=False`` is for batches that bring their manifests along. Where the catalog has
    groups, objects of another group are not found.
    """
    key = object_key(objects, batch, refs)
    group = key[:-1]
    named = batch.select(*group, F.col("content_id").alias("manifest_id")).distinct()
    named_refs = refs.join(named, [*group, "manifest_id"], "left_semi")
    chunks = chunk_problems(named_refs, objects).select(*key, "_chunk")
    judged = batch.join(chunks, key, "left")
    if not check_manifests:
        return judged.withColumnRenamed("_chunk", "problem")
    ready = objects.where("available").select(*key, F.col("kind").alias("_kind"))
    return (
        judged.join(ready, key, "left")
        .withColumn("problem", F.coalesce(_object_problem("MANIFEST"), "_chunk"))
        .drop("_kind", "_chunk")
    )


def append_changes(
    log: DataFrame,
    batch: DataFrame,
    refs: DataFrame,
    objects: DataFrame,
    check_manifests: bool = True,
    top: int | None = None,
) -> DataFrame:
    """Statuses of a batch of changes against the log, with the sequence each one holds.

    ``batch``: ``group_id, revision_id, content_id, arrival`` (unique, orders the batch).
    New revisions get the next sequences in arrival order, without a gap. A revision that is
    known, or that came earlier in the batch, is ``REPLAYED`` with its old sequence, or
    ``REVISION_CONTENT_MISMATCH`` when it names another content. The judged rows (ids, no
    payloads) are written once: they are read three times. ``top`` is the log's highest sequence
    where ``log`` is a part of it.
    """
    judged = with_object_problem(batch, refs, objects, check_manifests)
    return append_judged(log, judged, top).select(*batch.columns, "status", "sequence")


def append_judged(log: DataFrame, judged: DataFrame, top: int | None = None) -> DataFrame:
    """``append_changes`` of changes that have their ``problem`` already; all columns of ``judged`` are kept."""
    key = ["group_id", "revision_id"]
    rows = materialized(judged.join(known_changes(log), key, "left"))
    return append_known(log, rows, top=top).select(*judged.columns, "status", "sequence")


def known_changes(log: DataFrame) -> DataFrame:
    """What the log says of each revision, under names of its own."""
    return log.select(
        "group_id", "revision_id", F.col("content_id").alias("_old_content"), F.col("sequence").alias("_old_sequence")
    )


def append_known(log: DataFrame, rows: DataFrame, eligible: Column | None = None, top: int | None = None) -> DataFrame:
    """``append_judged`` of rows that have met ``known_changes`` and are written; only ``eligible`` ones are committed.

    The status of a row that is not ``eligible`` says nothing.
    """
    key = ["group_id", "revision_id"]
    fit = F.col("_old_content").isNull() & F.col("problem").isNull()
    fit = fit if eligible is None else fit & eligible
    first = (
        rows.where(fit)
        .groupBy(*key)
        .agg(F.min(F.struct("arrival", "content_id")).alias("_f"))
        .select(*key, F.col("_f.arrival").alias("arrival"), F.col("_f.content_id").alias("_first_content"))
    )
    numbered = dense_rank(first, "arrival", out="_rank").select(
        *key,
        F.col("arrival").alias("_first_arrival"),
        "_first_content",
        "_rank",
    )
    if top is None:
        top = F.lit(log.agg(F.coalesce(F.max("sequence"), F.lit(0))).scalar())
    else:
        top = F.lit(top)
    later = F.col("arrival") > F.col("_first_arrival")
    status = (
        F.when(
            F.col("_old_content").isNotNull(),
            F.when(F.col("_old_content") == F.col("content_id"), "REPLAYED").otherwise(
                "REVISION_CONTENT_MISMATCH"
            ),
        )
        .when(F.col("arrival") == F.col("_first_arrival"), "COMMITTED")
        .when(later & (F.col("_first_content") == F.col("content_id")), "REPLAYED")
        .when(later, "REVISION_CONTENT_MISMATCH")
        .otherwise(F.col("problem"))
    )
    return (
        rows.join(numbered, key, "left")
        .withColumn("status", status)
        .withColumn(
            "sequence",
            F.when(
                F.col("status").isin("COMMITTED", "REPLAYED"),
                F.coalesce(F.col("_old_sequence"), top + F.col("_rank")),
            ),
        )
        .select(*rows.columns, "status", "sequence")
    )


def create_log(log: DataFrame, base: str, buckets: int = BUCKETS) -> KeyedTable:
    """A log (``group_id, revision_id, content_id, sequence``) that finds revisions by their bucket."""
    top = log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("top")).first()["top"]
    return KeyedTable.create(log, base, ["group_id", "revision_id"], buckets, {"top": top})


def append_to_log(
    table: KeyedTable, batch: DataFrame, refs: DataFrame, objects: DataFrame, check_manifests: bool = True
) -> DataFrame:
    """``append_changes`` of a batch to a stored log, and the statuses it gave.

    Only the buckets of the batch's revisions are read, and the highest sequence is a fact of the
    table's version. A batch that loses to another writer is judged again, so sequences stay dense and unique.
    """
    statuses: list[DataFrame] = []

    def make(now: Manifest) -> tuple[DataFrame, dict]:
        part = table.read(now, table.touched(batch, now))
        judged = materialized(append_changes(part, batch, refs, objects, check_manifests, now.facts["top"]))
        fresh = judged.where("status = 'COMMITTED'").select(*part.columns)
        top = fresh.agg(F.max("sequence").alias("top")).first()["top"]
        statuses.append(judged)
        return fresh, {"top": now.facts["top"] if top is None else top}

    table.append(make)
    return statuses[-1]


def change_page(
    log: DataFrame, provenance: DataFrame, group: int | str, after: int, n: int
) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows past the cursor and a one-row summary.

    A row without provenance, or whose provenance names another content, makes the page
    fail: ``page_error`` is set and the page must not be served.
    """
    mine = log.where(F.col("group_id") == group)
    page = read_changes(log, group, after).orderBy("sequence").limit(n)
    signed = provenance.where(F.col("group_id") == group).select(
        "revision_id",
        F.col("content_id").alias("_signed_content"),
        F.col("author").alias("author"),
        F.col("tag").alias("tag"),
    )
    rows = page.join(signed, "revision_id", "left").withColumn(
        "row_error",
        first_status(
            (F.col("_signed_content").isNull(), "UNSIGNED_CHANGE"),
            (F.col("_signed_content") != F.col("content_id"), "PROVENANCE_CONTENT_MISMATCH"),
        ),
    ).drop("_signed_content")
    one = F.lit(1).alias("_one")
    cut = rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.max("sequence").alias("last_sequence"),
        F.min_by("row_error", F.when(F.col("row_error").isNotNull(), F.col("sequence"))).alias("page_error"),
    ).select("*", one)
    top = mine.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("high_watermark")).select("*", one)
    summary = cut.join(top, "_one").select(
        "records",
        "last_sequence",
        "high_watermark",
        (F.col("high_watermark") > F.coalesce("last_sequence", F.lit(after))).alias("has_more"),
        "page_error",
    )
    return rows, summary


def paginate(log: DataFrame, n: int) -> DataFrame:
    """Page number of every record, pages of ``n`` records per group in sequence order."""
    ranked = dense_rank(log, "sequence", by=["group_id"], out="_rank")
    return ranked.withColumn("page", F.expr(f"(_rank - 1) div {n} + 1")).drop("_rank")


def page_summary(pages: DataFrame) -> DataFrame:
    """Bounds of each page and whether more records follow it."""
    per_page = pages.groupBy("group_id", "page").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
    )
    tops = per_page.groupBy("group_id").agg(F.max("last_sequence").alias("high_watermark"))
    return per_page.join(tops, "group_id").withColumn(
        "has_more", F.col("last_sequence") < F.col("high_watermark")
    )
