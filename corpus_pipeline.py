"""From raw documents to a token mix: five stages, each on all rows the one before kept.

1. ``quality``: documents that the positive-unlabelled classifier rejects go.
2. ``near_duplicates``: one document of each group linked by shingles stays.
3. ``secrets``: what the secret scan finds is replaced by a mark; no document goes.
4. ``mix``: sources are taken up to their target weights, in whole epochs and one
   cut; a text taken twice stands twice.
5. ``tokens``: texts become token ids; a row for each row of the mix, with the
   text that the ids decode to.

Stages 1 to 4 return the columns of ``documents``. Very long texts pass every stage
whole. Null texts and nulls in any column stay what they are until the mix, which takes
texts without words 0 times; repeated rows are copies, of which one stays; equal ids are
told apart by their texts; columns of other names are carried along to the mix. A table
without rows stays one without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import bpe, jaccard_join, mixing, quality, secrets
from vitrina.llm.common import read_table, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: The classifier and the encoder are not expressible in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
