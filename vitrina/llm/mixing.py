"""Mixing sources to target weights.

Every row gets a hash-random key; within its source, rows stand in key order and
the words before each row are a distributed prefix sum: sums per (source, key
prefix) give each prefix its offset, and a running sum inside one (source,
prefix) does the rest. A source of any share is thus spread over ``16 **
PREFIX`` even groups. The cut falls at the source's exact budget: whole epochs
first, then the rows before the cut, the last of them in part.

Budgets: source k (in code-point order, null last) has weight ``weights[k %
len(weights)]`` and gets its share of ``share`` times all words, at most
``max_epochs`` times its own size; what stands above goes to the others by
weight until none is above. Sorted by size / weight, a source is capped exactly
if the level reached without the sources before it is at least its own; so two
running sums over the table of sources (one row each) give the level.

Defined cases: null or empty texts have size 0 and are taken 0 times; the null
source is a source of its own; rows with equal keys (repeated rows) stand in
order of id, and which of two equal rows is cut does not show; a source or table
without words gets target 0; an empty table gives an empty result. Columns not
asked for are ignored, and clashing names cannot occur as only ``id_col``,
``source_col``, ``text_col`` and the names in ``carry`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, read_table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the key that make the groups of a source: 4,096 groups.
PREFIX = 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with ``target`` added; one row a source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0.0)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("words", F.sum(F.col("source_size").cast("double")).over(everything) * F.lit(float(share)))
        .withColumn("reached", (F.col("words") - F.coalesce(F.sum("cap").over(before), zero)) / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("capped", F.col("reached") >= F.col("level"))
        .withColumn("left", F.col("words") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), zero))
        .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
        .select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("left") / F.col("open") * F.col("weight")).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.0,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row.

    ``taken``: the words the mix takes from the row, repeats counted. ``carry``
    adds the input row as a struct column ``row``.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []),
    ).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))))
    rows = rows.withColumn("prefix", F.substring("key", 1, PREFIX))
    sums = rows.groupBy("source", "prefix").agg(F.sum("size").alias("part"))
    goals = targets(sums.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, max_epochs)
    up_to = W.partitionBy("source").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("part").over(up_to), F.lit(0)))

    def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        """a with the columns of b, nulls equal in the keys."""
        b = b.select(*(F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in b.columns))
        return a.join(b, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]).drop(*(f"r_{k}" for k in keys))

    offsets = same(offsets.drop("part"), goals, "source")
    inside = W.partitionBy("source", "prefix").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    out = (
        same(rows, offsets, "source", "prefix")
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    partly = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    taken = (F.col("epochs") * F.col("size") + partly).cast("bigint").alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", taken, *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a text is taken.

    The row at a source's cut is taken in part: its text ends after the last
    word taken, and ``n_chars``, if there is such a column, follows.
    """
    text_col = options.get("text_col", "text")
    taken = mix(docs, carry=True, **options).where("taken > 0")
    text = F.col("row").getField(text_col)
    part = (F.col("taken") % F.col("size")).cast("int")
    between = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    cut = F.array_join(F.slice(F.split(text, between), F.lit(1), part), "")
    whole = F.array_repeat(text, F.floor(F.col("taken") / F.col("size")).cast("int"))
    texts = taken.withColumn("one", F.explode(F.when(part > 0, F.concat(whole, F.array(cut))).otherwise(whole)))
    names = {text_col: F.col("one"), "n_chars": F.length("one").cast("bigint")}
    return texts.select(*((names[c] if c in names else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes from every document."""
    return mix(read_table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap, CAST(SUM(source_size) OVER () AS DOUBLE) AS words FROM s
), l AS (
  SELECT *, (words - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= cap / weight AS capped FROM w
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    (words - COALESCE(SUM(cap) FILTER (WHERE capped) OVER (), 0)) / SUM(weight) FILTER (WHERE NOT capped) OVER () * weight END AS target FROM l
), b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(FLOOR(t.target + 0.5) AS BIGINT) AS budget,
    SUM(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || COALESCE(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
  budget // source_size * size + LEAST(GREATEST(budget % source_size - before, 0), size) END AS BIGINT) AS taken FROM b
"""
