"""Spark session settings shared by tests, bench and jobs.

Only settings that matter for plan shape or correctness live here. On a
cluster the session normally comes from the platform; ``configure`` then
only fills in values that are still unset, so cluster-level choices (shuffle
partitions, checkpoint dir, broadcast threshold) win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conf values we want unless the cluster says otherwise.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime (post-shuffle) broadcast conversion: AQE turns a sort-merge join
    # into a broadcast join only when the measured side is under this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``DEFAULTS`` where unset."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names; raises when there is none."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder; in local mode without one a scratch folder, on a cluster it must be named."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()) and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vitrina-"))
    return checkpoint_dir(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared checkpoint folder, lineage cut."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_work_dir(spark: SparkSession) -> str:
    """A new folder's name under the shared checkpoint folder."""
    return f"{_shared(spark)}/work-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vitrina") -> SparkSession:
    """Session for tests and the bench: local mode, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("VITRINA_DRIVER_MEMORY", "4g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def suggested_shuffle_partitions(
    spark: SparkSession, path: str, target_bytes: int = 256 << 20, minimum: int | None = None
) -> int:
    """Shuffle partitions so the largest shuffle (about the input size) lands
    near ``target_bytes`` per partition; AQE coalesces what turns out smaller.

    A suggestion only: the caller decides whether to set it.
    """
    floor = minimum if minimum is not None else spark.sparkContext.defaultParallelism
    return max(floor, -(-input_bytes(spark, path) // target_bytes))
