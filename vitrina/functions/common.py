"""Column helpers shared by every report.

Money stays DECIMAL inside a plan and becomes a DOUBLE rounded to cents only
at the output boundary (``money``). Averages of money are computed from
integer cents so that rounding is exact half-up (``avg_cents``): averaging
DECIMALs first and rounding after can double-round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.literals import CANCELLED, OPEN_STATUSES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Output form of a money value: rounded to cents, as DOUBLE."""
    return F.round(col(c), 2).cast("double")


def cents(c: str | Column) -> Column:
    """Exact money value in integer cents (DECIMAL(38,0))."""
    return (col(c) * F.lit(100)).cast("decimal(38,0)")


def avg_cents(total_cents: Column, n: Column) -> Column:
    """Half-up average of an integer-cent sum over ``n`` values, as money.

    ``(2*cents + n) div (2*n)`` is round-half-up of ``cents / n`` for
    non-negative sums; NULL when ``n`` is 0.
    """
    n_dec = n.cast("decimal(38,0)")
    a = (total_cents * 2 + n_dec).cast("decimal(38,0)")
    b = (n_dec * 2).cast("decimal(38,0)")
    # (a - a mod b) / b is an exact integer, so the decimal division never rounds.
    q = ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")
    return F.when(n > 0, q.cast("double") / F.lit(100.0))


def count_long(c: str | Column | None = None) -> Column:
    return F.count(F.lit(1) if c is None else col(c)).cast("long")


def not_cancelled(status: str | Column = "status") -> Column:
    return col(status) != F.lit(CANCELLED)


def kept_after_outer_join(status: str | Column = "status") -> Column:
    """``status != 'Cancelado' OR status IS NULL`` applied after outer joins."""
    s = col(status)
    return (s != F.lit(CANCELLED)) | s.isNull()


def is_open(status: str | Column = "status") -> Column:
    return col(status).isin(*OPEN_STATUSES)


def full_name(first: str | Column = "first_name", last: str | Column = "last_name") -> Column:
    """``first || ' ' || last``: NULL when either part is NULL."""
    return F.concat(col(first), F.lit(" "), col(last))


def after_row(sort: str, ascending: bool, key: str, last: tuple, collation: str | None = None) -> Column:
    """Rows that follow ``last`` (its sort value and key) in the order of ``sort``, then ascending ``key``.

    Nulls are last in ascending and first in descending order. With it, a deep page
    costs as much as the first one.
    """
    value, last_key = last
    c = F.col(sort) if collation is None else F.collate(F.col(sort), collation)
    tie = F.col(key) > F.lit(last_key)
    if value is None:
        return (c.isNull() & tie) if ascending else (c.isNotNull() | tie)
    v = F.lit(value) if collation is None else F.collate(F.lit(value), collation)
    beyond = (c > v) | c.isNull() if ascending else c < v
    return beyond | ((c == v) & tie)


def paginate(df: DataFrame, order: list[Column], page: int, limit: int, show_all: bool = False) -> DataFrame:
    """Sorted page ``page`` (1-based) of ``limit`` rows; all rows if ``show_all``."""
    ordered = df.orderBy(*order)
    if show_all:
        return ordered
    if limit < 0:
        raise ValueError(f"limit must be >= 0, got {limit}")
    offset = (page - 1) * limit
    if offset < 0:
        raise ValueError(f"page must be >= 1, got {page}")
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def count_pages(df: DataFrame, limit: int, show_all: bool = False) -> DataFrame:
    """(total, total_pages) of a listing, one row; all on one page if ``show_all``."""
    n = F.count(F.lit(1)).cast("long")
    pages = F.lit(1).cast("long") if show_all else F.ceil(F.col("total") / F.lit(limit)).cast("long")
    return df.agg(n.alias("total")).withColumn("total_pages", pages)
