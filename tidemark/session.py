"""Session settings the operators count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits the hot side of a skewed join and merges small shuffle partitions. Joins
# here look unique keys up from a larger side, so a split side stays correct.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to a session somebody else built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session without
    one (tests, a laptop) gets a temporary folder; executors of a cluster would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if shared:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def step_folder(spark: SparkSession, name: str) -> str:
    """A new name in the checkpoint folder."""
    checkpoint_ready(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    For steps that are repeated: unlike ``checkpoint`` this runs the plan once and starts from the
    table's real size. A checkpoint keeps the estimate of the plan it replaces, and estimates of
    joins are products, so a loop of joins over checkpoints soon plans with numbers of millions
    of digits. Zstandard, as most of what is kept are digests in hex.
    """
    spark = df.sparkSession
    path = step_folder(spark, "step")
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.step_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialized`` that no later plan reads."""
    for table in tables:
        jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(table.step_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
