"""File sinks.

CSV follows the shop's export: header row, every value quoted, a quote
doubled inside values, NULL and '' both written as ``""`` (trap S21). Spark
also quotes the header and writes no byte-order mark; output is a directory
of part files, one per task, so an export never funnels through one task or
the driver. ``csv_lines`` renders the same lines as a DataFrame column
(``to_csv``), which is what the registered export query returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true",
    "quoteAll": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "encoding": "UTF-8",
}


#: Columns that hold money wherever they appear.
MONEY = frozenset(
    "price wholesale_price additional_price amount amount_usd total subtotal shipping discount_applied item_total revenue "
    "total_revenue total_amount avg_amount total_spent lifetime_value avg_order_value avg_ticket min_price max_price".split()
)


def _number(f: T.StructField) -> Column:
    """A double as an exact decimal, never in scientific notation: money with 2 places, others as they are."""
    c = F.col(f.name)
    return c.cast("decimal(38,2)") if f.name in MONEY else c.cast("decimal(38,6)")


def _text(df: DataFrame) -> DataFrame:
    """Every column as text (the export stringifies values): money with 2 places, other doubles without idle zeros."""

    def text(f: T.StructField) -> Column:
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.col(f.name).cast("string").alias(f.name)
        plain = _number(f).cast("string")
        return (plain if f.name in MONEY else F.regexp_replace(plain, r"\.?0+$", "")).alias(f.name)

    return df.select(*[text(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _text(df).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """One ``line`` per row, formatted as ``write_csv`` writes it (header not included)."""
    opts = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "encoding")}
    text = _text(df)
    return text.select(F.to_csv(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text.columns]), opts).alias("line"))


JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def _json_ready(df: DataFrame) -> DataFrame:
    """Money as exact 2-decimal JSON numbers, never in scientific notation; other doubles as they are."""
    return df.select(
        *[
            F.col(f.name).cast("decimal(38,2)").alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name in MONEY
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; NULL fields are kept, money as 2-decimal numbers."""
    _json_ready(df).write.mode(mode).options(**JSON_OPTIONS).json(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row in a ``value`` column, as ``write_json`` writes it."""
    ready = _json_ready(df)
    return ready.select(F.to_json(F.struct(*ready.columns), JSON_OPTIONS).alias("value"))


def write_snapshot(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> DataFrame:
    """Write a job's output table (parquet) and return it read back.

    Reading the written table back cuts the lineage: downstream jobs start
    from files in shared storage, so a lost executor never recomputes the
    job that produced them. ``partition_by`` lays the table out by columns
    (e.g. the order month) so later date filters prune whole directories.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
