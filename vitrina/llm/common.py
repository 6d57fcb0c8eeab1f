"""Helpers shared by the operators: checkpoints, prefix sums, components, words.

Words are maximal runs of anything but the six ASCII white-space bytes, after
lower-casing A-Z; ``bytes.lower().split()`` does exactly that on UTF-8.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word in Java and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch one only in local mode with none set."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="vitrina-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder (lineage cut)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def bind(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_totals(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array<bigint>, in O(n * block).

    Sums of blocks are accumulated first, so an array of n values costs
    (n / block)^2 + n * block steps rather than n^2.
    """
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")

    def of(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc.at + x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
        return F.aggregate(values, first, step, lambda acc: acc.out)

    def cut(xs: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
        return F.transform(places, lambda b: F.slice(xs, b * block + 1, F.lit(block)))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda xs: F.aggregate(xs, zero, lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, of(sums, zero), of))

    return bind(lengths, lambda xs: F.when(F.size(xs) > 0, bind(cut(xs), joined)).otherwise(none))


#: Edges that one task may take to finish a search for components (16 bytes each).
EDGES_A_TASK = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the components of a bounded number of edges, by union-find."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, places = np.unique(np.concatenate(parts), return_inverse=True)
    up = list(range(len(nodes)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for x, y in places.reshape(-1, 2).tolist():
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)  # places are in order of nodes, so the top is the smallest
    labels = nodes[[top(k) for k in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])


def components(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """Connected components of undirected edges (a, b: bigint) as (node, label).

    ``label`` is the smallest node of the component. Large-star and small-star steps
    alternate: every step is a grouped minimum and an equi-join, its result goes to
    the checkpoint folder, and no neighbour list is ever collected. Once no more than
    ``edges_a_task`` edges are left (a fixed bound), one task joins them. Nodes
    without an edge do not appear. No edges: an empty frame.
    """
    edges = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def large_star(links: DataFrame) -> DataFrame:
        """Every larger neighbour of a node is linked with the node's smallest neighbour (or the node)."""
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, F.col("u") == F.col("w")).where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b"))

    def small_star(links: DataFrame) -> DataFrame:
        """A node and its smaller neighbours are linked with the smallest of them."""
        least = links.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m"))
        moved = links.join(least, F.col("b") == F.col("w")).where("m <> a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return moved.union(least.select(F.col("m").alias("a"), F.col("w").alias("b"))).distinct()

    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    while seen[0] > edges_a_task:
        edges = checkpoint(small_star(large_star(edges)))
        now = mark(edges)
        if now == seen:
            labels = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
            return labels.union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        seen = now
    return edges.coalesce(1).mapInArrow(_joined, "node long, label long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of each word, kept per task for at most ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def field(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(-1))


def sampled_ids(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows of ``ids`` (column ``doc_id``), the first by a seeded hash."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text, and what ``ids`` holds) of the sampled documents. ``ids`` has a stated bound, so it is broadcast."""
    return docs.join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).drop("_id", "doc_id")
