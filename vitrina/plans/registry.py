"""Query registry: key -> callable(spark, sf_dir) -> DataFrame, and oracle SQL.

Each callable loads the shop tables from ``sf_dir`` (lazy, no action) and
runs one report/job with its default parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import carts, catalog, customers, export, indexes, ingest, pricing, quality, reports, terms
from ..session import shared_work_dir
from ..sources.tables import Tables, load
from ..streaming.retention import retention_replay

QueryFn = Callable[[SparkSession, str], DataFrame]

_TABLE_FNS: dict[str, Callable[[Tables], DataFrame]] = {}


def table_fn(key: str, fn: Callable[[Tables], DataFrame]) -> None:
    _TABLE_FNS[key] = fn


_LOADED: dict[tuple[str, str], Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """Mapped tables, built once per (session, directory).

    The frames are plans: reusing them saves the per-query source listing
    and plan construction. One dimension is persisted: ``categories`` is a
    DISTINCT over the product source (a shuffle) with one row per brand,
    joined by most reports, so it is computed once per session (memory and
    disk; a lost block is recomputed from its lineage).
    """
    key = (f"{spark.sparkContext.applicationId}:{id(spark)}", sf_dir)
    if key not in _LOADED:
        t = load(spark, sf_dir)
        _LOADED[key] = t.replace(categories=t.categories.persist(StorageLevel.MEMORY_AND_DISK))
    return _LOADED[key]


def _wrap(fn: Callable[[Tables], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tables_for(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


for _name in (
    "sales_by_category",
    "top_categories",
    "monthly_revenue",
    "top_products",
    "top_products_dashboard",
    "customer_lifetime_value",
    "low_stock_products",
    "low_stock_recent_sales",
    "top_low_stock",
    "pending_orders",
    "payment_status_summary",
    "shipping_zone_revenue",
    "sales_by_currency",
    "kpis",
    "admin_kpis",
    "admin_low_stock",
    "recent_orders",
    "orders_by_currency_all",
):
    table_fn(_name, getattr(reports, _name))

table_fn("available_stock", catalog.available_stock)
table_fn("catalog_page", lambda t: catalog.catalog_page(t, sort="price-asc", page=2, limit=10))
table_fn("catalog_total", catalog.catalog_count)
table_fn("catalog_names", catalog.catalog_names)
table_fn("category_total", lambda t: catalog.category_total(t, "brand-13"))
table_fn("search_total", lambda t: catalog.search_total(t, "Gear"))
table_fn("admin_total", lambda t: catalog.admin_total(t, stock="low-stock"))
table_fn("category_page", lambda t: catalog.category_page(t, "brand-13"))
table_fn("search_products", lambda t: catalog.search_products(t, "Gear", show_all=True))
table_fn("admin_product_list", lambda t: catalog.admin_product_list(t, stock="low-stock", sort="name", show_all=True))
for _name in (
    "price_range",
    "price_range_by_category",
    "featured_sample",
    "category_list",
    "products_by_ids",
    "product_facets",
    "product_ratings",
    "latest_reviews",
    "stock_label",
    "stock_band",
    "stock_band_counts",
):
    table_fn(_name, getattr(catalog, _name))

# small parts, so that many products have several
table_fn("product_detail", lambda t: catalog.product_detail(t, chunk=20))
table_fn("product_detail_json", lambda t: catalog.product_detail_json(t, chunk=20))

for _name in ("customer_profile", "customer_order_stats", "customer_recent_orders"):
    table_fn(_name, getattr(customers, _name))
table_fn("clv_page", lambda t: customers.clv_page(t, page=2, limit=20))
table_fn("clv_page_meta", lambda t: customers.clv_page_meta(t, page=2, limit=20))
for _name in (
    "cart_contents",
    "cart_totals",
    "cart_item_count",
    "cart_distinct_products",
    "cart_merge",
    "cart_set_quantity",
    "cart_remove",
    "retention_cleanup",
    "retention_counts",
    "cart_product_popularity",
):
    table_fn(_name, getattr(carts, _name))

# a limit that carts of these tables reach
table_fn("cart_add", lambda t: carts.cart_add(t, max_products=20))

table_fn("price_orders", pricing.price_orders)
table_fn("convert_currency", pricing.convert_currency)
for _name in ("constraint_audit", "referential_audit", "uniqueness_audit", "table_row_counts"):
    table_fn(_name, getattr(quality, _name))
for _name in (
    "clean_products",
    "apply_product_changes",
    "clean_customers",
    "link_identities",
    "slugify",
    "slug_consistency",
):
    table_fn(_name, getattr(ingest, _name))
table_fn("export_csv_full", lambda t: export.export_csv(t, "full"))
table_fn("export_json_pending", lambda t: export.export_json_report(t, "pending-shipments"))
table_fn("export_json_categories", lambda t: export.export_json_report(t, "sales-by-category"))
table_fn("export_json_top_products", lambda t: export.export_json_report(t, "top-products"))
table_fn("export_json_monthly", lambda t: export.export_json_report(t, "monthly-revenue"))
table_fn("export_json_low_stock", lambda t: export.export_json_report(t, "low-stock"))
for _name in ("export_csv", "kpi_long", "report_registry", "export_json", "abbreviate_amount", "chart_series_monthly"):
    table_fn(_name, getattr(export, _name))


for _name in ("promotion_admission", "dated_conversion", "shipping_quotes"):
    table_fn(_name, getattr(terms, _name))
table_fn("active_customers", indexes.active_customers)
table_fn("search_indexed", lambda t: indexes.indexed_search(t, shared_work_dir(t.spark), "Gear"))
table_fn("catalog_deep_page", lambda t: indexes.directory_page(t, shared_work_dir(t.spark)))
table_fn("clv_deep_page", lambda t: indexes.clv_directory_page(t, shared_work_dir(t.spark)))
table_fn("admin_deep_page", lambda t: indexes.admin_directory_page(t, shared_work_dir(t.spark), sort="price-desc"))
table_fn("retention_stream", lambda t: retention_replay(t.spark, t.cart_items, shared_work_dir(t.spark), carts.AS_OF_CARTS, files=2))


def table_functions() -> dict[str, Callable[[Tables], DataFrame]]:
    return dict(_TABLE_FNS)


def queries() -> dict[str, QueryFn]:
    return {key: _wrap(fn) for key, fn in _TABLE_FNS.items()}


def oracle_sql() -> dict[str, str]:
    from . import oracle_catalog, oracle_jobs, oracle_people, oracle_reports, oracle_terms  # noqa: F401  (register statements)
    from .oracle_sql import ORACLE, register

    if "report_registry" not in ORACLE:
        # row counts of the download reports, from their own oracle statements
        from ..operators.export import REPORT_FILES

        report_keys = {
            "full": "kpi_long",
            "sales-by-category": "sales_by_category",
            "top-products": "top_products",
            "customer-orders": "customer_lifetime_value",
            "monthly-revenue": "monthly_revenue",
            "low-stock": "low_stock_products",
        }
        register(
            "report_registry",
            "\nUNION ALL\n".join(
                f"SELECT '{kind}' AS report_type, '{REPORT_FILES[kind]}' AS file_name, "
                f"CAST(COUNT(*) AS BIGINT) AS rows FROM (\n{ORACLE[key]}\n) r{i}"
                for i, (kind, key) in enumerate(report_keys.items())
            ),
        )

    return {k: v for k, v in ORACLE.items() if k in _TABLE_FNS}
