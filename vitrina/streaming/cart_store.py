"""Cart table in buckets of owners: a batch writes what it touches, not the whole table.

Layout under a root folder on storage that driver and executors share:

* ``data/v=<n>/bucket=<b>``: the lines of bucket b as batch n left them;
* ``manifest/v=<n>``: for each bucket the version whose files are live after batch n.

A line's bucket is a hash of its owner; lines that a customer and a session share are in
bucket -1, which every batch reads. A batch reads the buckets of its owners, as the
manifest with the highest number *below* its own names them, applies the merge rules and
writes those buckets and its manifest, last. So a replayed batch starts from the same
lines and writes the same files again, and a batch that dies leaves no manifest and
changes nothing. Bytes written follow the owners in the batch. ``compact`` writes all
live buckets into one version; versions that no kept manifest names can then be removed.

The driver handles one row a bucket.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.carts import cart_merge, cart_merge_snapshot
from ..session import checkpoint_dir
from ..sources.tables import Tables
from .cart_sync import REQUEST_SCHEMA, _file_system

BUCKETS = 256
SHARED = -1
_MANIFEST = "bucket int, version long"


def bucket_of(buckets: int = BUCKETS):
    """Bucket of a cart line by its owner."""
    both = F.col("customer_id").isNotNull() & F.col("session_id").isNotNull()
    owner = F.when(F.col("customer_id").isNotNull(), F.concat(F.lit("c"), F.col("customer_id").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("session_id")))
    return F.when(both, F.lit(SHARED)).otherwise(F.pmod(F.xxhash64(owner), F.lit(buckets))).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    jvm, path, fs = _file_system(spark, f"{root}/manifest")
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """Live version of each bucket that has lines, after ``version``."""
    return {r.bucket: r.version for r in spark.read.schema(_MANIFEST).json(f"{root}/manifest/v={version}").collect()}


def _write_manifest(spark: SparkSession, root: str, version: int, live: dict[int, int]) -> None:
    spark.createDataFrame(sorted(live.items()), _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifest/v={version}")


def _write(lines: DataFrame, root: str, version: int, buckets: int) -> set[int]:
    """Write lines by bucket; the buckets that have any."""
    dealt = lines.withColumn("bucket", bucket_of(buckets)).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v={version}")
    spark = lines.sparkSession
    jvm, path, fs = _file_system(spark, f"{root}/data/v={version}")
    return {int(s.getPath().getName()[7:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")}


def create(lines: DataFrame, root: str, buckets: int = BUCKETS, version: int = -1) -> None:
    """A new store with these lines."""
    _write_manifest(lines.sparkSession, root, version, dict.fromkeys(_write(lines, root, version, buckets), version))


def read(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The lines after ``version`` (the last one), of all buckets or some."""
    version = versions(spark, root)[-1] if version is None else version
    paths = [f"{root}/data/v={v}/bucket={b}" for b, v in sorted(manifest(spark, root, version).items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_batch(t: Tables, batch: DataFrame, batch_id: int, root: str, buckets: int = BUCKETS) -> set[int]:
    """One micro-batch of additions (customer_id, product_id, size, color, quantity); the buckets it wrote.

    Results per key go to ``results/batch_id=<n>``. Running it again gives the same files.
    """
    spark = t.spark
    before = [v for v in versions(spark, root) if v < batch_id]
    if not before:
        raise ValueError(f"no store at {root}")
    live = manifest(spark, root, before[-1])
    owners = batch.select(F.col("customer_id").cast("long").alias("customer_id"), F.lit(None).cast("string").alias("session_id"))
    touched = {r.b for r in owners.select(bucket_of(buckets).alias("b")).distinct().collect()} | {SHARED}
    shop = t.replace(cart_items=read(spark, root, t.cart_items.schema, before[-1], touched))
    cart_merge(shop, batch).write.mode("overwrite").parquet(f"{root}/results/batch_id={batch_id}")
    written = _write(cart_merge_snapshot(shop, batch, batch_tag=batch_id), root, batch_id, buckets)
    kept = {b: v for b, v in live.items() if b not in touched}
    _write_manifest(spark, root, batch_id, kept | dict.fromkeys(written, batch_id))
    return written


def start_store_sync(t: Tables, requests_dir: str, root: str, *, buckets: int = BUCKETS, available_now: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """Additions that arrive as parquet files, a micro-batch after the other, into the store at ``root``."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(t.spark), "cart_store")
    reader = t.spark.readStream.schema(REQUEST_SCHEMA).parquet(requests_dir)
    writer = reader.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(t, batch, batch_id, root, buckets)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def compact(spark: SparkSession, root: str, schema: T.StructType, buckets: int = BUCKETS) -> int:
    """Write the live lines of all buckets anew under the last version's manifest; the number of buckets.

    The files go to a version of their own below all batches (the next free negative
    number), so a batch that is replayed after it finds what it found before.
    """
    last = versions(spark, root)[-1]
    jvm, path, fs = _file_system(spark, f"{root}/data")
    lowest = min(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    written = _write(read(spark, root, schema, last), root, min(lowest, 0) - 1, buckets)
    _write_manifest(spark, root, last, dict.fromkeys(written, min(lowest, 0) - 1))
    return len(written)


def remove_unused(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete manifests before the last ``keep`` (2 at least: a replay reads the one before the last), and the files no kept one names."""
    known = versions(spark, root)
    kept = known[-max(2, keep) :]
    used = {v for n in kept for v in manifest(spark, root, n).values()}
    removed = []
    for folder, names in (("manifest", set(known) - set(kept)), ("data", None)):
        jvm, path, fs = _file_system(spark, f"{root}/{folder}")
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("v=") and (int(name[2:]) in names if names is not None else int(name[2:]) not in used):
                fs.delete(status.getPath(), True)
                removed += [int(name[2:])] if folder == "data" else []
    return sorted(removed)
