"""Retention of idle guest carts as a Structured Streaming job (Q43 as a stream).

Updates of cart lines (id, customer_id, session_id, updated_at) arrive as parquet files.
A line's updates form sessions: a session goes on while the next update comes within
``days``, and ends when the watermark passes that time after its last update. What ends is
a line that has been idle; it is written once, with its last update. A line without a
customer has then expired; an update that comes later (but within ``delay`` out of order)
revives it, as it is newer than the update written.

State is one row per open session, kept by Spark's state store by line id: no group is
larger than the updates of a line that arrive together. Sessions are merged by their
ends, so neither the order of the files nor a replay of the stream changes what is
written. The result is a file sink with Spark's own commit log; the checkpoint lives
under ``spark.checkpoint.dir``.

The end of a session is exclusive in Spark, while the batch rule wants *more* than
``days``; so the gap is one microsecond longer. ``close_at`` rows (id null) move the
watermark on when no line changes, as a clock does.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.carts import RETENTION_DAYS
from ..session import checkpoint_dir

UPDATE_SCHEMA = "id long, session_id string, customer_id long, updated_at timestamp_ntz"


def idle_sessions(updates: DataFrame, days: int = RETENTION_DAYS, delay: str = "0 seconds") -> DataFrame:
    """(id, customer_id, last_update) of every session of updates that has ended; batch or stream."""
    stamped = updates.select("id", "customer_id", F.col("updated_at").cast("timestamp").alias("at")).withWatermark("at", delay)
    sessions = stamped.groupBy(F.session_window("at", f"{int(days)} days 1 microsecond").alias("session"), "id")
    last = sessions.agg(F.max(F.struct("at", "customer_id")).alias("last"))
    return last.select("id", F.col("last.customer_id").alias("customer_id"), F.col("last.at").cast("timestamp_ntz").alias("last_update"))


def start_retention(
    spark: SparkSession,
    updates: DataFrame,
    out_dir: str,
    *,
    days: int = RETENTION_DAYS,
    delay: str = "0 seconds",
    available_now: bool = True,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start the stream over ``updates`` (a streaming frame with ``UPDATE_SCHEMA``); idle sessions go to ``out_dir``."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "retention")
    writer = idle_sessions(updates, days, delay).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out_dir).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def with_expiry(lines: DataFrame, idle: DataFrame) -> DataFrame:
    """``lines`` with ``expired``: a guest's line whose last update ended a session."""
    ended = idle.filter(F.col("id").isNotNull() & F.col("customer_id").isNull()).groupBy(F.col("id").alias("_id")).agg(F.max("last_update").alias("_ended"))
    expired = F.col("customer_id").isNull() & (F.col("updated_at") <= F.col("_ended"))
    return lines.join(ended, F.col("id") == F.col("_id"), "left").withColumn("expired", F.coalesce(expired, F.lit(False))).drop("_id", "_ended")


def retention_replay(spark: SparkSession, lines: DataFrame, work_dir: str, as_of: str, days: int = RETENTION_DAYS, files: int = 4) -> DataFrame:
    """The stream run over the updates of ``lines`` up to ``as_of``: ``lines`` with ``expired``.

    The updates are written as ``files`` files a micro-batch each takes one of, the clock's
    row last.
    """
    updates = f"{work_dir}/updates"
    schema = ["id", "session_id", "customer_id", "updated_at"]
    lines.select(*schema).repartition(files).write.parquet(f"{updates}/lines")
    clock = spark.range(1).select(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("long").alias("customer_id"), F.lit(as_of).cast("timestamp_ntz").alias("updated_at")
    )
    # updates may lie anywhere before the clock's time: nothing is late before it strikes
    source = spark.readStream.schema(UPDATE_SCHEMA).option("maxFilesPerTrigger", 1)
    checkpoint = f"{work_dir}/checkpoint"
    delay = "36500 days"
    start_retention(spark, source.parquet(f"{updates}/*"), f"{work_dir}/idle", days=days, delay=delay, checkpoint=checkpoint).awaitTermination()
    clock.coalesce(1).write.parquet(f"{updates}/clock")
    start_retention(spark, source.parquet(f"{updates}/*"), f"{work_dir}/idle", days=days, checkpoint=checkpoint).awaitTermination()
    return with_expiry(lines, spark.read.parquet(f"{work_dir}/idle"))
