"""Cart sync as a Structured Streaming job.

Cart-addition requests (customer_id, product_id, size, color, quantity) arrive as
parquet files. Every micro-batch runs the batch ``cart_merge`` rules against the cart
as the batches before it left it and writes

* the per-key results, ``<out>/results/batch_id=<n>``;
* the next cart snapshot, ``<out>/carts/v=<n>``.

A batch reads the latest snapshot with a number *below* its own and writes only paths
named by its number, with overwrite. So a batch that Spark replays, because its commit
was not recorded, starts from the same cart and gives the same rows again. The stream's
checkpoint lives under the session's ``spark.checkpoint.dir``, which must be set: with it
a new session goes on where the last one ended. Snapshots older than the last two can be
removed (``remove_old_snapshots``); a replay needs the one before the last at most.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.carts import cart_merge, cart_merge_snapshot
from ..session import checkpoint_dir
from ..sources.tables import Tables

REQUEST_SCHEMA = "customer_id long, product_id long, size string, color string, quantity int"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshot_versions(spark: SparkSession, carts_root: str) -> list[int]:
    """Numbers of the complete snapshots, ascending."""
    jvm, root, fs = _file_system(spark, carts_root)
    if not fs.exists(root):
        return []
    paths = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def cart_before(spark: SparkSession, carts_root: str, batch_id: int, initial: DataFrame) -> DataFrame:
    """The cart that a batch starts from: the latest snapshot below its number, or the initial table."""
    below = [v for v in snapshot_versions(spark, carts_root) if v < batch_id]
    return spark.read.parquet(f"{carts_root}/v={below[-1]}") if below else initial


def apply_batch(spark: SparkSession, tables: Tables, batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """One micro-batch; running it again gives the same files."""
    root = out_dir.rstrip("/")
    t = tables.replace(cart_items=cart_before(spark, f"{root}/carts", batch_id, tables.cart_items))
    cart_merge(t, batch).write.mode("overwrite").parquet(f"{root}/results/batch_id={batch_id}")
    cart_merge_snapshot(t, batch, batch_tag=batch_id).write.mode("overwrite").parquet(f"{root}/carts/v={batch_id}")


def remove_old_snapshots(spark: SparkSession, out_dir: str, keep: int = 2) -> list[int]:
    """Delete all but the last ``keep`` (2 at least) snapshots; returns the numbers deleted."""
    root = f"{out_dir.rstrip('/')}/carts"
    old = snapshot_versions(spark, root)[: -max(2, keep)]
    for version in old:
        jvm, path, fs = _file_system(spark, f"{root}/v={version}")
        fs.delete(path, True)
    return old


def start_cart_sync(
    spark: SparkSession,
    tables: Tables,
    requests_dir: str,
    out_dir: str,
    *,
    available_now: bool = True,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start the stream; with ``available_now`` it drains the files present and stops."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "cart_sync")
    reader = spark.readStream.schema(REQUEST_SCHEMA).parquet(requests_dir)
    writer = reader.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(spark, tables, batch, batch_id, out_dir))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
