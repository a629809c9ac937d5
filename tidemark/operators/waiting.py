"""Records that wait for objects, found again by the objects that arrive.

An inverted index has one row per waiting record and absent object, with the number of objects the
record still lacks. An arriving object is looked up in it; a record is complete when as many of its
objects have arrived as it lacked. Nothing else of the waiting records is read.

Defined cases: a record listed twice waits once; an object that arrives twice counts once; arrivals
nothing waits for are ignored; a record that lacks nothing has no row, see ``complete_already``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import object_key
from tidemark.operators.manifests import missing_objects

RECORD = ["group_id", "revision_id"]


def _absent(waiting: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    group = object_key(objects, refs)[:-1]
    named = waiting.select(*RECORD, F.col("content_id").alias("manifest_id")).distinct()
    wanted = refs.join(named.select(*group, "manifest_id").distinct(), [*group, "manifest_id"], "left_semi")
    absent = missing_objects(wanted, objects, ["manifest_id"])
    return named.join(absent.withColumnRenamed("content_id", "object_id"), [*group, "manifest_id"], "left").select(
        *RECORD, "object_id"
    )


def waiting_index(waiting: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(group_id, revision_id, object_id, missing) of records (``group_id, revision_id, content_id``)."""
    lacks = _absent(waiting, refs, objects).where(F.col("object_id").isNotNull()).distinct()
    counts = lacks.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("missing"))
    return lacks.join(counts, RECORD)


def complete_already(waiting: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(group_id, revision_id) of records none of whose objects is absent."""
    return (
        _absent(waiting, refs, objects)
        .groupBy(*RECORD)
        .agg(F.count("object_id").alias("_n"))
        .where("_n = 0")
        .select(*RECORD)
    )


def wake(index: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that became complete by ``arrived`` objects, and the index without them.

    ``arrived``: ``content_id``, and ``group_id`` where objects have groups.
    """
    key = [c for c in ("group_id", "content_id") if c in arrived.columns]
    here = arrived.select(*key).distinct().withColumnRenamed("content_id", "object_id")
    on = [c for c in here.columns]
    met = index.join(here, on, "left_semi")
    counted = met.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("_met"), F.max("missing").alias("_missing"))
    complete = counted.where(F.col("_met") == F.col("_missing")).select(*RECORD)
    left = index.join(here, on, "left_anti").join(counted.select(*RECORD, "_met"), RECORD, "left")
    rest = left.select(*RECORD, "object_id", (F.col("missing") - F.coalesce("_met", F.lit(0))).alias("missing"))
    return complete, rest
