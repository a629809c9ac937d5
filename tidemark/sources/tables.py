"""Keyed upserts over tables kept as numbered parquet versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPDATE, NOTHING = "update", "nothing"


def upsert(
    target: DataFrame, updates: DataFrame, keys: list[str], mode: str = UPDATE, order: str | None = None
) -> DataFrame:
    """``target`` after inserting ``updates``; ``mode`` says what a known key does.

    With repeats of a key in ``updates``, ``update`` keeps the last by ``order`` and
    ``nothing`` the first, found by a grouping that combines map-side.
    """
    if mode not in (UPDATE, NOTHING):
        raise ValueError(f"unknown mode {mode}")
    columns = target.columns
    if order is not None:
        pick = F.max_by if mode == UPDATE else F.min_by
        values = [c for c in columns if c not in keys]
        updates = (
            updates.groupBy(*keys).agg(pick(F.struct(*values), order).alias("_row")).select(*keys, "_row.*")
        )
    updates = updates.select(*columns)
    if mode == UPDATE:
        return target.join(updates.select(*keys), keys, "left_anti").select(*columns).unionByName(updates)
    return target.unionByName(updates.join(target.select(*keys), keys, "left_anti").select(*columns))


def filesystem(spark: SparkSession, location: str):
    """The location as a path, and the file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, base: str) -> int:
    """Number of the newest complete version, 0 when there is none."""
    path, fs = filesystem(spark, base)
    if not fs.exists(path):
        return 0
    done = []
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            mark = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if fs.exists(mark):
                done.append(int(name[1:]))
    return max(done, default=0)


def read_table(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/v{current_version(spark, base)}")


def write_version(df: DataFrame, base: str) -> int:
    """Write the next version; readers of the old one are not disturbed.

    The write goes to a name of its own and is renamed when complete, so a job that dies
    leaves no half version behind. A writer claims its number by creating a file that must not
    exist yet, so two writers never publish the same version; the number of a writer that died
    stays unused.
    """
    spark = df.sparkSession
    staged = f"{base}/.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    source, fs = filesystem(spark, staged)
    version = current_version(spark, base) + 1
    while True:
        target, _ = filesystem(spark, f"{base}/v{version}")
        claim, _ = filesystem(spark, f"{base}/.claim-v{version}")
        if not fs.exists(target) and fs.createNewFile(claim):
            break
        version += 1
    if not fs.rename(source, target):
        raise OSError(f"could not publish {base}/v{version}")
    return version
