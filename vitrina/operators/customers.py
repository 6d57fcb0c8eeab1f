"""Customer queries, for all customers at once (optionally restricted by a key frame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_long, money, not_cancelled, paginate
from ..sources.tables import Tables
from .reports import customer_lifetime_value


def _only(df: DataFrame, customers: DataFrame | None) -> DataFrame:
    return df if customers is None else df.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")


def customer_profile(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """Q32: customer with city and country (dimension joins are tiny)."""
    c = _only(t.customers, customers)
    return (
        c.join(t.cities.select("city_id", "city_name", "country_id"), "city_id", "left")
        .join(t.countries.select("country_id", "country_name"), "country_id", "left")
        .select(
            "customer_id", "first_name", "last_name", "email", "phone", "created_at", "last_login",
            "city_name", "country_name",
        )
    )


def customer_order_stats(t: Tables, customers: DataFrame | None = None) -> DataFrame:
    """Q33: non-cancelled order count and total spent per customer (0 if none)."""
    stats = (
        t.orders.filter(not_cancelled() & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(count_long().alias("total_orders"), F.sum("total").alias("total_spent"))
    )
    return _only(t.customers.select("customer_id"), customers).join(stats, "customer_id", "left").select(
        "customer_id",
        F.coalesce(F.col("total_orders"), F.lit(0)).cast("long").alias("total_orders"),
        money(F.coalesce(F.col("total_spent"), F.lit(0))).alias("total_spent"),
    )


def customer_recent_orders(t: Tables, n: int = 5, customers: DataFrame | None = None) -> DataFrame:
    """Q34: latest ``n`` orders per customer, any status (ties broken by order id).

    The ``rn <= n`` filter becomes a partial WindowGroupLimit before the
    shuffle, so a customer with a huge number of orders is cut to n rows per
    map task before its window task.
    """
    o = _only(t.orders.filter(F.col("customer_id").isNotNull()), customers)
    w = Window.partitionBy("customer_id").orderBy(F.col("order_date").desc(), F.col("order_id").asc())
    return (
        o.select("customer_id", "order_id", "order_date", "total", "status", "currency_code")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= n)
        .withColumn("total", money("total"))
    )


def clv_params(page, limit) -> tuple[int, int]:
    """The analytics endpoint's paging rule: page<1 -> 1 (limit unchecked), else limit outside 1..100 -> 20."""
    try:
        p = int(page) or 1
    except (TypeError, ValueError):
        p = 1
    try:
        lim = int(limit) or 20
    except (TypeError, ValueError):
        lim = 20
    if p < 1:
        return 1, lim
    if lim < 1 or lim > 100:
        return p, 20
    return p, lim


def clv_page(t: Tables, page=1, limit=20) -> DataFrame:
    """Q35: one page of the lifetime-value report, highest value first (NULLs last)."""
    p, lim = clv_params(page, limit)
    order = [F.col("lifetime_value").desc_nulls_last(), F.col("customer_id").asc()]
    return paginate(customer_lifetime_value(t), order, p, lim)


def clv_page_meta(t: Tables, page=1, limit=20) -> DataFrame:
    """Q35 paging block: page, limit, total, total_pages (one row, one count)."""
    p, lim = clv_params(page, limit)
    return customer_lifetime_value(t).agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(p).alias("page"),
        F.lit(lim).alias("limit"),
        F.col("total").cast("long").alias("total"),
        F.ceil(F.col("total") / F.lit(lim)).cast("long").alias("total_pages"),
    )


__all__ = [
    "customer_profile",
    "customer_order_stats",
    "customer_recent_orders",
    "clv_page",
    "clv_page_meta",
    "clv_params",
]
