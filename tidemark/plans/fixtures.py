"""Inputs of the registered queries, derived from the given tables.

Each function reads whole tables. The matching SQL is in ``plans.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.vv import vv_entry
from tidemark.operators.ranking import dense_rank

# The event types, which play the devices of the change log.
DEVICES = ["click", "error", "purchase", "signup", "view"]
EPOCH = 500
ME = "click"
KEY = "group-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(column: str, width: int = 12):
    return F.lpad(F.col(column).cast("string"), width, "0")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with a path and a device."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_no"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
        F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string")).alias("device"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a replicated change log with version vectors.

    A device knows its own past of a file and everything up to the last barrier of ``EPOCH``
    events. Counts are taken per file and epoch first, so the running sums span epochs.
    """
    e = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("sequence"),
        F.col("user_id").alias("file_no"),
        F.col("event_type").alias("author"),
        F.expr(f"event_id div {EPOCH}").alias("epoch"),
        F.when(F.col("event_id") % 7 == 0, "TOMBSTONE").otherwise("FILE").alias("kind"),
        padded("event_id").alias("revision_id"),
    )
    before = Window.partitionBy("file_no").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    per_epoch = e.groupBy("file_no", "epoch").agg(
        *[F.count_if(F.col("author") == d).alias(f"n_{d}") for d in DEVICES]
    )
    known = per_epoch.select(
        "file_no", "epoch", *[F.coalesce(F.sum(f"n_{d}").over(before), F.lit(0)).alias(f"k_{d}") for d in DEVICES]
    )
    inside = F.row_number().over(
        Window.partitionBy("file_no", "epoch", "author").orderBy("sequence")
    )
    counters = [
        vv_entry(F.lit(d), F.col(f"k_{d}") + F.when(F.col("author") == d, F.col("_inside")).otherwise(0))
        for d in DEVICES
    ]
    return (
        e.withColumn("_inside", inside)
        .join(known, ["file_no", "epoch"])
        .select(
            "sequence",
            F.col("file_no").cast("string").alias("path_id"),
            F.col("file_no").cast("string").alias("file_id"),
            "revision_id",
            "kind",
            "author",
            F.filter(F.array(*counters), lambda x: x["c"] > 0).alias("vv"),
            F.concat(F.lit("r"), "revision_id").alias("content_id"),
        )
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ordered references of manifests (orders) to chunks (parts)."""
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "_order", F.col("l_linenumber").cast("bigint") * 2**40 + F.col("l_partkey")
    )
    ranked = dense_rank(
        lines, "_order", by=["l_orderkey"], ties=["l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    )
    return ranked.select(
        F.col("l_orderkey").alias("manifest_id"),
        F.col("l_partkey").alias("content_id"),
        F.col("l_quantity").cast("bigint").alias("size"),
        (F.col("rank") - 1).alias("chunk_index"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the object catalog; every tenth is not available."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("content_id"),
        F.lit("CHUNK").alias("kind"),
        F.col("p_size").cast("bigint").alias("size"),
        (1000000 + (F.col("p_partkey") * 7919) % 86400000).alias("verified_at_ms"),
        (F.col("p_partkey") % 10 != 0).alias("available"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members; one in twenty is unknown, a negative balance means revoked."""
    revoked = F.col("c_acctbal") < 0
    return table(spark, sf_dir, "customer").where("c_custkey % 20 <> 3").select(
        F.col("c_custkey").alias("device"),
        F.lit(1).cast("bigint").alias("group_id"),
        F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("tag_key"),
        F.when(F.col("c_custkey") % 25 == 0, "OWNER").otherwise("MEMBER").alias("role"),
        F.when(revoked, "REVOKED").otherwise("ACTIVE").alias("status"),
        F.lit(0).cast("bigint").alias("added_at_ms"),
        F.when(revoked, F.lit(5).cast("bigint")).alias("revoked_at_ms"),
    )


def _order_size():
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored heads, the previous snapshot."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(
        F.col("o_orderkey").alias("path_id"),
        F.when(F.col("o_orderkey") % 19 == 0, "TOMBSTONE").otherwise("FILE").alias("kind"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_id"),
        F.array(
            vv_entry(F.lit("a"), F.col("o_orderkey") % 5 + 1), vv_entry(F.lit("m"), F.col("o_custkey") % 3 + 1)
        ).alias("vv"),
        F.col("o_orderpriority").alias("display"),
        _order_size().alias("size"),
        F.lit(1000).cast("bigint").alias("mtime_ms"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("chunks_digest"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the current listing: changed sizes, names and times for some keys."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select(
        key.alias("path_id"),
        F.when(key % 23 == 0, F.upper(F.concat("o_orderpriority", F.lit("x"))))
        .otherwise(F.col("o_orderpriority"))
        .alias("display"),
        (_order_size() + F.when(key % 17 == 0, 1).otherwise(0)).alias("size"),
        (1000 + F.when(key % 29 == 0, 1).otherwise(0)).cast("bigint").alias("mtime_ms"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("chunks_digest"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses turned into path strings, most of them hostile."""
    bare = F.regexp_replace("url", "^https?://", "")
    pid = F.col("page_id")
    kind = pid % 8
    path = (
        F.when(kind == 0, F.concat(F.lit("/"), bare))
        .when(kind == 1, F.replace(bare, F.lit("/"), F.lit("//")))
        .when(kind == 2, F.concat(F.lit("a/../"), pid.cast("string")))
        .when(kind == 3, F.concat(F.lit("docs/CON."), pid.cast("string")))
        .when(kind == 4, F.concat(F.lit("docs/name"), pid.cast("string"), F.lit(".")))
        .when(kind == 5, F.upper(F.concat(F.lit("docs/f"), (pid % 40).cast("string"), F.lit(".txt"))))
        .when(kind == 6, F.concat(F.lit("docs/f"), (pid % 40 - 1).cast("string"), F.lit(".txt")))
        .otherwise(bare)
    )
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered payload parts."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("manifest_id"),
        F.col("turn").alias("chunk_index"),
        F.col("text").alias("payload"),
    )


def one_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as changes of a single path, by two files whose records never replace each other.

    Of every 4000 changes the later half, and every tenth of the others, is behind the head.
    """
    e = F.col("event_id")
    behind = (e % 10 == 3) | (e % 4000 >= 2000)
    counter = F.when(behind, 1 + e % 5).otherwise(e + 10)
    return table(spark, sf_dir, "events").select(
        (e + 1).alias("sequence"),
        F.lit("p").alias("path_id"),
        F.when(e % 3 == 0, "fa").otherwise("fb").alias("file_id"),
        F.lpad(e.cast("string"), 12, "0").alias("revision_id"),
        F.when(e % 7 == 0, "TOMBSTONE").otherwise("FILE").alias("kind"),
        F.array(F.struct(F.lit("a").alias("d"), counter.cast("bigint").alias("c"))).alias("vv"),
        F.concat(F.lit("c"), e.cast("string")).alias("content_id"),
        F.concat(F.lit("by "), "event_type").alias("author"),
    )


def transfer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the receipts of one transfer per user.

    The first event of a user opens the transfer, the last closes it; every ninth append
    claims offset 0. Offsets are running sums per user, taken per block of events first.
    """
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("object_no"),
        (F.floor(F.col("value") * 10).cast("bigint") + 1).alias("len"),
        F.expr("event_id div 4096").alias("block"),
    )
    good = F.col("event_id") % 9 != 0
    counted = e.withColumn("n", F.when(good, F.col("len")).otherwise(0))
    per_block = counted.groupBy("object_no", "block").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("object_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select("object_no", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("object_no", "block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    append = (
        counted.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(before, ["object_no", "block"])
        .select(
            "object_no",
            (F.col("event_id") * 2 + 1).alias("event_id"),
            F.lit("APPEND").alias("op"),
            F.lit(None).cast("string").alias("request_id"),
            F.lit(None).cast("bigint").alias("size"),
            F.when(good, F.col("before") + F.col("inside")).otherwise(0).alias("start_offset"),
            "len",
        )
    )
    totals = counted.groupBy("object_no").agg(
        F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.sum("n").alias("size")
    )
    nothing = F.lit(None).cast("bigint")
    begin = totals.select(
        "object_no",
        (F.col("first") * 2).alias("event_id"),
        F.lit("BEGIN").alias("op"),
        F.when(F.col("object_no") % 31 == 0, "0" * 32)
        .otherwise(F.lpad(F.col("object_no").cast("string"), 32, "7"))
        .alias("request_id"),
        "size",
        nothing.alias("start_offset"),
        nothing.alias("len"),
    )
    end = totals.select(
        "object_no",
        (F.col("last") * 2 + 2).alias("event_id"),
        F.when(F.col("object_no") % 10 == 4, "CANCEL").otherwise("COMPLETE").alias("op"),
        F.lit(None).cast("string").alias("request_id"),
        nothing.alias("size"),
        nothing.alias("start_offset"),
        nothing.alias("len"),
    )
    return append.unionByName(begin).unionByName(end).select(
        F.concat(F.lit("p"), (F.col("object_no") % 3).cast("string")).alias("peer"),
        F.col("object_no").cast("string").alias("content_id"),
        "event_id",
        "op",
        "request_id",
        "size",
        "start_offset",
        "len",
    )


def one_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the receipts of a single transfer.

    Every 500 events begin anew; every other such block ends with a cancellation. Of the others
    one in sixteen states its true size, so that the transfer is stored there.
    """
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("event_id div 500").alias("block"),
        (F.floor(F.col("value") * 10).cast("bigint") + 1).alias("len"),
    )
    good = F.col("event_id") % 9 != 0
    counted = e.withColumn("n", F.when(good, F.col("len")).otherwise(0))
    inside = Window.partitionBy("block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    nothing, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def rows(frame, at, op, request=no_text, size=nothing, offset=nothing, length=nothing):
        return frame.select(
            F.lit("p").alias("peer"),
            F.lit("x").alias("content_id"),
            at.alias("event_id"),
            op.alias("op"),
            request.alias("request_id"),
            size.alias("size"),
            offset.alias("start_offset"),
            length.alias("len"),
        )

    before = counted.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    offset = F.when(good, F.col("before")).otherwise(0)
    size = F.sum("n") + F.when(F.first("block") % 16 == 15, 0).otherwise(5)
    totals = counted.groupBy("block").agg(size.alias("size"))
    begin = F.lit("BEGIN"), F.repeat(F.lit("7"), F.lit(32)), F.col("size")
    end = F.when(F.col("block") % 2 == 0, "CANCEL").otherwise("COMPLETE")
    return (
        rows(before, F.col("event_id") * 3 + 1, F.lit("APPEND"), offset=offset, length=F.col("len"))
        .unionByName(rows(totals, F.col("block") * 1500, *begin))
        .unionByName(rows(totals, F.col("block") * 1500 + 1499, end))
    )


def hex_id(column: str):
    """64-hex identifier of a numeric key, equal to the SQL side's ``sha256``."""
    return F.sha2(F.col(column).cast("string").cast("binary"), 256)
