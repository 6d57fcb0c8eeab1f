"""Approximate nearest neighbours with a permutation index.

``PIVOTS`` vectors, the first by a hash, are the pivots (their number bounds what
is collected and sent to tasks). A vector is represented by its ``LENGTH`` most
similar pivots in order. Vectors are dealt into blocks; in a block every pivot
has an inverted file of the vectors that name it, with its place in their order.
A query adds up, over its own pivots' files, what each vector shares with it:
the footrule distance of two orders with missing pivots placed last is a
constant less twice the sum of LENGTH - max(place, place). The nearest
``SHARE`` of a block (``LEAST`` at least, so that few rows give all) are then scored exactly, and each
block's ``k`` best meet in a ranking per query.

Queries are dealt into blocks as well, so a task holds one block of either; each
query meets every block of vectors. Of vectors that are equal, number for
number, only those of the k + 1 smallest ids are indexed, and k rows of each id:
no others can be among a query's k nearest, as one id at most is the query's own.
Rows equal in both are counted before the shuffle, and a rank limit before the
next one keeps groups of equal vectors small.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite
components take no part, nor do null ids and vectors whose length is not the
most common one (the smallest of equals); rows with the query's id are its own;
a query id that stands in several rows asks with its smallest vector; equal
scores go by smaller id; fewer candidates than k give all; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, read_table

PIVOTS, LENGTH = 256, 64
SHARE, LEAST = 0.3, 50
BLOCK, QUERY_BLOCK = 20_000, 2_000
QUERY_EVERY, K = 50, 5


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (common["n"] if common else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def index(rows: DataFrame, pivots: int = PIVOTS, length: int = LENGTH, k: int = K) -> DataFrame:
    """(vec_id, vector, places) of what can be among k nearest: ``places`` are the nearest pivots of each vector, nearest first."""
    same = W.partitionBy("vector").orderBy("vec_id")
    ids = rows.groupBy("vector", "vec_id").agg(F.count("*").alias("n"))
    ids = ids.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    kept = ids.withColumn("row", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))))
    chosen = ids.where("copy = 1").orderBy(F.xxhash64("vector"), "vec_id").limit(pivots).select("vector").collect()
    if not chosen:
        return kept.select("vec_id", "vector", F.array().cast("array<smallint>").alias("places"))
    of = _unit(np.array([r["vector"] for r in chosen], np.float64))
    length = min(length, len(of))

    @F.pandas_udf("array<smallint>")
    def places(vectors: pd.Series) -> pd.Series:
        x = _unit(np.array(vectors.tolist(), np.float64))
        order = np.argsort(-(x @ of.T), axis=1, kind="stable")[:, :length].astype(np.int16)
        return pd.Series(list(order))

    return kept.select("vec_id", "vector", places(F.col("vector")).alias("places"))


class Block:
    """Inverted files of one block of vectors, in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, places = ids[order], vectors[order], places[order]
        self.length = places.shape[1]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        by_pivot = np.argsort(places.ravel(), kind="stable")
        self.rows = (by_pivot // self.length).astype(np.int32)
        self.at = (by_pivot % self.length).astype(np.int32)
        self.starts = np.searchsorted(places.ravel()[by_pivot], np.arange(int(places.max()) + 2))

    def nearest(self, own: int, vector: np.ndarray, places: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of the block."""
        common = np.zeros(len(self.ids), np.int32)
        for at, pivot in enumerate(places):
            if pivot + 1 < len(self.starts):
                file = slice(self.starts[pivot], self.starts[pivot + 1])
                common[self.rows[file]] += self.length - np.maximum(self.at[file], at)
        n = min(len(common), max(least, int(np.ceil(share * len(common)))) + 1)
        found = np.argpartition(-common, n - 1)[:n] if n < len(common) else np.arange(len(common))
        found = np.sort(found[self.ids[found] != own])
        scores = (self.vectors[found] * vector).sum(1) / (self.norms[found] * np.sqrt((vector * vector).sum()))
        best = np.argsort(-scores, kind="stable")[:k]
        return self.ids[found[best]], scores[best]


def search(
    queries: DataFrame, indexed: DataFrame, k: int = K, share: float = SHARE, least: int = LEAST, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``indexed`` for every row of ``queries``.

    Both have the columns of ``index``.
    """
    n_blocks = max(1, -(-indexed.count() // block))
    n_query_blocks = max(1, -(-queries.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = indexed.withColumn("b", deal(n_blocks)).withColumn("q", every(n_query_blocks))
    right = queries.withColumn("q", deal(n_query_blocks)).withColumn("b", every(n_blocks))

    def task(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(vectors) and len(asked):
            matrix = lambda s, kind: np.array(s.tolist(), kind)
            files = Block(vectors["vec_id"].to_numpy(), matrix(vectors["vector"], np.float64), matrix(vectors["places"], np.int16))
            for own, vector, places in zip(asked["vec_id"], matrix(asked["vector"], np.float64), asked["places"]):
                out += [(own, x, s) for x, s in zip(*files.nearest(own, vector, places, k, share, least))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(task, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K, pivots: int = PIVOTS, length: int = LENGTH, **options) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all rows."""
    rows = usable(vectors)
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.withColumn("n", F.row_number().over(W.partitionBy("vec_id").orderBy("vector"))).where("n = 1").drop("n")
    indexed = checkpoint(index(rows, pivots, length, k))
    # a query's order of pivots is that of its vector in the index
    places = indexed.select("vector", "places").dropDuplicates(["vector"])
    return search(asked.join(places, "vector").select("vec_id", "vector", "places"), indexed, k, **options)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every 50th vector."""
    return nearest(read_table(spark, sf_dir, "embeddings"))
