"""Analytical reports (dashboard views, KPIs, exports' data).

All functions are lazy: ``Tables -> DataFrame``. Money leaves as DOUBLE
rounded to cents (``money``), counts as LONG.

Outer join followed by ``WHERE status != 'Cancelado' OR status IS NULL``
(trap S1) is evaluated as conditional aggregation: each fact is aggregated
to the dimension key with an "all rows" count and "kept rows" aggregates,
then joined 1:1 to the dimension. A dimension row survives when it has no
fact rows at all, or at least one kept row. This avoids outer-joining the
large fact into the dimension (AQE cannot split the non-preserved side of a
skewed outer join), and every large shuffle is an aggregation with a
map-side partial or an inner join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import (
    avg_cents,
    cents,
    count_long,
    full_name,
    is_open,
    kept_after_outer_join,
    money,
    not_cancelled,
)
from ..sources.tables import Tables


def _item_rows(t: Tables) -> DataFrame:
    """order_items LEFT JOIN orders: one row per item with its order status.

    ``matched_order_id`` is the order's id (NULL when the order is missing).
    """
    orders = t.orders.select("order_id", F.col("order_id").alias("matched_order_id"), "status")
    items = t.order_items.select("order_id", "product_id", "quantity", "unit_price")
    return items.join(orders, "order_id", "left")


def sales_by_category(t: Tables) -> DataFrame:
    """Q01: per category distinct orders, units and revenue (cancelled excluded).

    Order items are aggregated by (category, order), an order being kept or not as a
    whole; the second aggregate, by category, then counts rows instead of distinct
    orders. A second scan, of the items' product ids alone, tells which products no item
    names: an outer join of products would have the large side where skew can't be split. A category survives the outer-join filter (trap S1)
    when it has no product, a product that no item names, or a kept item.
    """
    kept = kept_after_outer_join()
    products = t.products.select("product_id", "category_id")
    per_order = (
        _item_rows(t)
        .join(products, "product_id")
        .groupBy("category_id", "matched_order_id")
        .agg(
            F.max(kept.cast("int")).alias("_kept"),
            F.sum(F.when(kept, F.col("quantity"))).alias("_units"),
            F.sum(F.when(kept, F.col("quantity") * F.col("unit_price"))).alias("_revenue"),
        )
    )
    stats = per_order.groupBy("category_id").agg(
        F.count(F.when(F.col("_kept") == 1, F.col("matched_order_id"))).alias("total_orders"),
        F.sum("_units").alias("units_sold"),
        F.sum("_revenue").alias("revenue"),
        F.max("_kept").alias("_any_kept"),
    )
    sold = t.order_items.select(F.col("product_id").alias("_sold")).distinct()
    idle = (
        products.join(sold, F.col("product_id") == F.col("_sold"), "left")
        .groupBy("category_id")
        .agg(F.max(F.col("_sold").isNull()).alias("_idle"))
    )
    out = (
        t.categories.select("category_id", "category_name")
        .join(idle, "category_id", "left")
        .join(stats, "category_id", "left")
        .filter(F.col("_idle").isNull() | F.col("_idle") | (F.col("_any_kept") == 1))
    )
    return out.select(
        "category_id",
        "category_name",
        F.coalesce(F.col("total_orders"), F.lit(0)).cast("long").alias("total_orders"),
        F.col("units_sold").cast("long").alias("units_sold"),
        money("revenue").alias("revenue"),
    ).orderBy(F.col("revenue").desc_nulls_last(), "category_id")


def top_categories(t: Tables, n: int = 10) -> DataFrame:
    """Q01 as the dashboard reads it: the ``n`` largest revenues, no revenue first (trap S3)."""
    return sales_by_category(t).orderBy(F.col("revenue").desc_nulls_first(), "category_id").limit(n)


def monthly_revenue(t: Tables) -> DataFrame:
    """Q02: per month orders, revenue, half-up average, distinct customers.

    Orders are aggregated by (month, customer) first, so the month's customers are
    counted as rows. Order ids are unique (``uniqueness_audit`` checks it), so
    orders are counted as rows too.
    """
    o = t.orders.filter(not_cancelled())
    month = F.trunc("order_date", "month").cast("timestamp_ntz")
    per_customer = o.groupBy(month.alias("month"), "customer_id").agg(
        F.count(F.lit(1)).alias("_orders"),
        F.sum("total").alias("_revenue"),
        F.sum(cents("total")).alias("_cents"),
        F.count("total").alias("_n"),
    )
    agg = per_customer.groupBy("month").agg(
        F.sum("_orders").cast("long").alias("total_orders"),
        F.sum("_revenue").alias("revenue"),
        F.sum("_cents").alias("_cents"),
        F.sum("_n").alias("_n"),
        F.count("customer_id").cast("long").alias("unique_customers"),
    )
    return agg.select(
        "month",
        "total_orders",
        money("revenue").alias("revenue"),
        avg_cents(F.col("_cents"), F.col("_n")).alias("avg_order_value"),
        "unique_customers",
    ).orderBy(F.col("month").desc())


def _product_sales(t: Tables) -> DataFrame:
    """Per product over items LEFT JOIN orders: kept units/revenue and survival.

    One aggregation of the item rows by product (partial on the map side).
    """
    kept = kept_after_outer_join()
    return _item_rows(t).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_n_items"),
        F.count(F.when(kept, 1)).alias("_n_kept"),
        F.sum(F.when(kept, F.col("quantity"))).alias("units_sold"),
        F.sum(F.when(kept, F.col("quantity") * F.col("unit_price"))).alias("revenue"),
    )


def _with_product_sales(products: DataFrame, t: Tables) -> DataFrame:
    """Products LEFT JOIN items LEFT JOIN orders WHERE kept, grouped per product."""
    return (
        products.join(_product_sales(t), "product_id", "left")
        .filter(F.col("_n_items").isNull() | (F.col("_n_kept") > 0))
        .drop("_n_items", "_n_kept")
    )


def top_products(t: Tables, n: int = 10) -> DataFrame:
    """Q03: top ``n`` products by units sold (never-sold included, NULLs last)."""
    products = t.products.select("product_id", "product_name", "category_id", "stock").join(
        t.categories.select("category_id", "category_name"), "category_id"
    )
    rows = _with_product_sales(products, t)
    return (
        rows.select(
            "product_id",
            "product_name",
            "category_name",
            F.col("units_sold").cast("long").alias("units_sold"),
            money("revenue").alias("revenue"),
            F.col("stock").alias("current_stock"),
        )
        .orderBy(F.col("units_sold").desc_nulls_last(), "product_id")
        .limit(n)
    )


def top_products_dashboard(t: Tables, n: int = 5) -> DataFrame:
    """Q04: dashboard top ``n`` with zeros for never-sold and a rank column."""
    products = t.products.select("product_id", "product_name", "category_id", "stock").join(
        t.categories.select("category_id", "category_name"), "category_id", "left"
    )
    rows = _with_product_sales(products, t).select(
        "product_id",
        "product_name",
        "category_name",
        F.coalesce(F.col("units_sold"), F.lit(0)).cast("long").alias("total_sold"),
        money(F.coalesce(F.col("revenue"), F.lit(0))).alias("total_revenue"),
        F.col("stock").alias("current_stock"),
    )
    top = rows.orderBy(F.col("total_sold").desc(), "product_id").limit(n)
    # n rows only: the window runs on the already-limited frame.
    from pyspark.sql import Window

    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("total_sold").desc(), "product_id"))
    ).orderBy("rank")


def customer_lifetime_value(t: Tables) -> DataFrame:
    """Q05: per customer orders, lifetime value, half-up average, last order date.

    Customers whose only orders are cancelled disappear; customers without
    orders stay with 0 / NULL (outer join then filter, trap S1).
    """
    kept = kept_after_outer_join()
    per_customer = (
        t.orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("_n_all"),
            F.count(F.when(kept, F.col("order_id"))).alias("total_orders"),
            F.sum(F.when(kept, F.col("total"))).alias("lifetime_value"),
            F.sum(F.when(kept, cents("total"))).alias("_cents"),
            F.count(F.when(kept, F.col("total"))).alias("_n"),
            F.max(F.when(kept, F.col("order_date"))).alias("last_order_date"),
        )
    )
    rows = (
        t.customers.select("customer_id", "email", full_name().alias("full_name"))
        .join(per_customer, "customer_id", "left")
        .filter(F.col("_n_all").isNull() | (F.col("total_orders") > 0))
    )
    return rows.select(
        "customer_id",
        "email",
        "full_name",
        F.coalesce(F.col("total_orders"), F.lit(0)).cast("long").alias("total_orders"),
        money("lifetime_value").alias("lifetime_value"),
        avg_cents(F.col("_cents"), F.col("_n")).alias("avg_order_value"),
        "last_order_date",
    )


def _low_stock_base(t: Tables, max_stock: int) -> DataFrame:
    return (
        t.products.filter(F.col("is_active") & (F.col("stock") < max_stock))
        .select("product_id", "product_name", "category_id", "stock", "price")
        .join(t.categories.select("category_id", "category_name"), "category_id")
    )


def _low_stock_out(base: DataFrame, sold: DataFrame) -> DataFrame:
    return (
        base.join(sold, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category_name",
            "stock",
            money("price").alias("price"),
            F.coalesce(F.col("sold"), F.lit(0)).cast("long").alias("sold_last_30_days"),
        )
        .orderBy("stock", "product_id")
    )


def low_stock_products(t: Tables, max_stock: int = 10) -> DataFrame:
    """Q06: active products with stock < 10 and units sold *as the view computes it*.

    The view's date/status predicate sits in the ON clause of a LEFT JOIN to
    orders that feeds nothing, so the figure is all-time units (trap S6).
    """
    sold = t.order_items.groupBy("product_id").agg(F.sum("quantity").alias("sold"))
    return _low_stock_out(_low_stock_base(t, max_stock), sold)


def top_low_stock(t: Tables, n: int = 10) -> DataFrame:
    """Q06 as the dashboard reads it: the ``n`` products with the least stock."""
    return low_stock_products(t).orderBy("stock", "product_id").limit(n)


AS_OF_ORDERS = "2001-08-01 00:00:00"


def low_stock_recent_sales(t: Tables, as_of: str = AS_OF_ORDERS, days: int = 30, max_stock: int = 10) -> DataFrame:
    """Q07: Q06 with the intended meaning: non-cancelled orders of the last ``days``."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    until = F.lit(as_of).cast("timestamp_ntz")
    recent = t.orders.filter(F.col("order_date").between(since, until) & not_cancelled()).select("order_id")
    sold = (
        t.order_items.select("order_id", "product_id", "quantity")
        .join(recent, "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("sold"))
    )
    return _low_stock_out(_low_stock_base(t, max_stock), sold)


def _address_geo(t: Tables) -> DataFrame:
    """customer_addresses LEFT JOIN cities LEFT JOIN countries (dims are tiny)."""
    return (
        t.customer_addresses.select("address_id", "city_id")
        .join(t.cities.select("city_id", "city_name", "country_id"), "city_id", "left")
        .join(t.countries.select("country_id", "country_name"), "country_id", "left")
        .select("address_id", "city_name", "country_name")
    )


def pending_orders(t: Tables) -> DataFrame:
    """Q08: open orders with resolved customer or guest identity and destination."""
    o = t.orders.filter(is_open())
    c = t.customers.select("customer_id", full_name().alias("_cname"), F.col("email").alias("_cemail"))
    rows = (
        o.join(c, "customer_id", "left")
        .join(_address_geo(t).withColumnRenamed("address_id", "shipping_address_id"), "shipping_address_id", "left")
    )
    return rows.select(
        "order_id",
        "order_date",
        F.coalesce(F.col("_cname"), F.col("guest_name"), F.lit("Invitado")).alias("customer_name"),
        F.coalesce(F.col("_cemail"), F.col("guest_email")).alias("email"),
        money("total").alias("total"),
        "currency_code",
        "status",
        "shipping_status",
        "city_name",
        "country_name",
        F.col("customer_id").isNull().alias("is_guest"),
    ).orderBy("order_date", "order_id")


def payment_status_summary(t: Tables) -> DataFrame:
    """Q09: per payment status count, total and half-up average."""
    agg = t.payments.groupBy("status").agg(
        count_long().alias("total_payments"),
        F.sum("amount").alias("total_amount"),
        F.sum(cents("amount")).alias("_cents"),
        F.count("amount").alias("_n"),
    )
    return agg.select(
        "status",
        "total_payments",
        money("total_amount").alias("total_amount"),
        avg_cents(F.col("_cents"), F.col("_n")).alias("avg_amount"),
    ).orderBy(F.col("total_amount").desc(), "status")


def zone_cities(t: Tables) -> DataFrame:
    """(zone_id, zone_name, city_id) for cities whose country code is in the zone's array.

    The array is made distinct before exploding, so a repeated code never
    duplicates rows (trap S10); a zone without any matching city keeps one
    row with NULL city_id.
    """
    codes = t.shipping_zones.select(
        "zone_id", "zone_name", F.explode(F.array_distinct("countries")).alias("country_code")
    )
    countries = codes.join(t.countries.select("country_code", "country_id"), "country_code").select(
        "zone_id", "country_id"
    ).distinct()
    cities = countries.join(t.cities.select("city_id", "country_id"), "country_id").select("zone_id", "city_id")
    return t.shipping_zones.select("zone_id", "zone_name").join(cities, "zone_id", "left")


def shipping_zone_revenue(t: Tables) -> DataFrame:
    """Q10: per zone name non-cancelled orders and revenue.

    Orders are read once and reduced to one row per address, then per city; all
    that follows is small. A zone survives (trap S1) when it has no city, a city
    without addresses, an address without orders, or a kept order. Order ids are
    unique, so orders are counted as rows.
    """
    kept = kept_after_outer_join()
    per_address = (
        t.orders.filter(F.col("shipping_address_id").isNotNull())
        .groupBy(F.col("shipping_address_id").alias("address_id"))
        .agg(F.count(F.when(kept, 1)).alias("_orders"), F.sum(F.when(kept, F.col("total"))).alias("_revenue"))
    )
    per_city = (
        t.customer_addresses.select("address_id", "city_id")
        .join(per_address, "address_id", "left")
        .groupBy("city_id")
        .agg(
            F.max(F.col("_orders").isNull() | (F.col("_orders") > 0)).alias("_survives"),
            F.sum("_orders").alias("_orders"),
            F.sum("_revenue").alias("_revenue"),
        )
    )
    # a city that several zones of one name reach counts its orders once and its revenue for each
    cities = zone_cities(t).groupBy("zone_name", "city_id").agg(F.count(F.lit(1)).alias("_zones"))
    return (
        cities.join(per_city, "city_id", "left")
        .groupBy("zone_name")
        .agg(
            F.max(F.coalesce(F.col("_survives"), F.lit(True))).alias("_survives"),
            F.coalesce(F.sum("_orders"), F.lit(0)).cast("long").alias("total_orders"),
            money(F.sum(F.col("_revenue") * F.col("_zones"))).alias("revenue"),
        )
        .filter("_survives")
        .drop("_survives")
        .orderBy(F.col("revenue").desc_nulls_last(), "zone_name")
    )


def sales_by_currency(t: Tables) -> DataFrame:
    """Q11: per currency non-cancelled orders and revenue (no conversion, trap S2)."""
    return (
        t.orders.filter(not_cancelled())
        .groupBy("currency_code")
        .agg(count_long().alias("total_orders"), money(F.sum("total")).alias("revenue"))
        .orderBy("currency_code")
    )


def _kpi_facts(t: Tables, categories: bool = False) -> DataFrame:
    """One tagged union of the tables the KPIs count, so every KPI is one aggregate pass."""
    spark_cols = dict(allowMissingColumns=True)
    facts = (
        t.customers.select(F.lit("customer").alias("_src"))
        .unionByName(t.products.select(F.lit("product").alias("_src"), "is_active"), **spark_cols)
        .unionByName(t.orders.select(F.lit("order").alias("_src"), "status", "total"), **spark_cols)
    )
    return facts.unionByName(t.categories.select(F.lit("category").alias("_src")), **spark_cols) if categories else facts


def _kpi_aggs() -> dict[str, Column]:
    src = F.col("_src")
    is_order = src == "order"
    kept_order = is_order & not_cancelled()
    return {
        "total_customers": F.count(F.when(src == "customer", 1)).cast("long"),
        "total_products": F.count(F.when((src == "product") & F.col("is_active"), 1)).cast("long"),
        "total_categories": F.count(F.when(src == "category", 1)).cast("long"),
        "total_orders": F.count(F.when(kept_order, 1)).cast("long"),
        "_revenue": F.sum(F.when(kept_order, F.col("total"))),
        "_cents": F.sum(F.when(kept_order, cents("total"))),
        "_n": F.count(F.when(kept_order, F.col("total"))),
        "pending_orders": F.count(F.when(is_order & is_open(), 1)).cast("long"),
    }


def kpis(t: Tables) -> DataFrame:
    """Q12: analytics KPI row."""
    a = _kpi_facts(t).agg(*[c.alias(k) for k, c in _kpi_aggs().items()])
    return a.select(
        "total_customers",
        "total_products",
        "total_orders",
        money(F.coalesce(F.col("_revenue"), F.lit(0))).alias("total_revenue"),
        F.coalesce(avg_cents(F.col("_cents"), F.col("_n")), F.lit(0.0)).alias("avg_ticket"),
        "pending_orders",
    )


def admin_kpis(t: Tables) -> DataFrame:
    """Q13: admin dashboard KPI row."""
    a = _kpi_facts(t, categories=True).agg(*[c.alias(k) for k, c in _kpi_aggs().items()])
    return a.select(
        "total_products",
        "total_categories",
        "total_orders",
        money(F.coalesce(F.col("_revenue"), F.lit(0))).alias("total_revenue"),
        "pending_orders",
        "total_customers",
    )


def admin_low_stock(t: Tables, threshold: int = 5, n: int = 5) -> DataFrame:
    """Q14: active products whose variant-aware stock is below ``threshold``, lowest ``n``."""
    from .catalog import with_available_stock

    rows = with_available_stock(t.products.filter("is_active"), t).filter(F.col("available_stock") < threshold)
    return (
        rows.select(
            "product_id",
            "product_name",
            F.col("available_stock").alias("total_stock"),
            money("price").alias("price"),
        )
        .orderBy("total_stock", "product_id")
        .limit(n)
    )


def recent_orders(t: Tables, n: int = 5) -> DataFrame:
    """Q15: latest ``n`` orders with customer name ('Invitado' for guests).

    The top-n is taken before the customer join (a left join on the
    customer key cannot change the order rows), so only n rows are joined.
    """
    top = t.orders.select("order_id", "order_date", "total", "status", "customer_id").orderBy(
        F.col("order_date").desc(), "order_id"
    ).limit(n)
    c = t.customers.select("customer_id", full_name().alias("_cname"))
    return top.join(c, "customer_id", "left").select(
        "order_id",
        "order_date",
        money("total").alias("total"),
        "status",
        F.coalesce(F.col("_cname"), F.lit("Invitado")).alias("customer_name"),
    ).orderBy(F.col("order_date").desc(), "order_id")


def orders_by_currency_all(t: Tables) -> DataFrame:
    """Q16: order count per currency, cancelled included."""
    return t.orders.groupBy("currency_code").agg(count_long().alias("total")).orderBy("currency_code")
