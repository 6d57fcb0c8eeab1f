"""Export-facing reports: KPI long form, amount abbreviation, chart series,
the report registry, and the CSV / JSON renderings of reports."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks import csv_lines, json_lines
from ..sources.tables import Tables
from . import customers, reports

# --- fixed values -----------------------------------------------------------
# Abbreviation ladder: (threshold, suffix), largest first.
LADDER_FULL = [(10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K")]
LADDER_SHORT = [(10**6, "M"), (10**3, "K")]
# Report types of the CSV download and their file names.
REPORT_FILES = {
    "full": "reporte_completo.csv",
    "sales-by-category": "ventas_por_categoria.csv",
    "top-products": "top_productos.csv",
    "customer-orders": "valor_clientes.csv",
    "monthly-revenue": "ingresos_mensuales.csv",
    "low-stock": "stock_bajo.csv",
}
DEFAULT_REPORT = "full"
FALLBACK_REPORT = "sales-by-category"
CHART_MONTHS = 12
# ---------------------------------------------------------------------------

KPI_COLUMNS = ["total_customers", "total_products", "total_orders", "total_revenue", "avg_ticket", "pending_orders"]


def kpi_long(t: Tables) -> DataFrame:
    """Q57: the KPI row as (metrica, valor) rows, '_' in names shown as spaces."""
    row = reports.kpis(t).select(*[F.col(c).cast("double").alias(c) for c in KPI_COLUMNS])
    long = row.unpivot([], KPI_COLUMNS, "metrica", "valor")
    return long.select(F.replace(F.col("metrica"), F.lit("_"), F.lit(" ")).alias("metrica"), "valor")


def kpi_text(t: Tables) -> DataFrame:
    """Q57 as the download writes it: counts as whole numbers, money with 2 decimals."""
    row = reports.kpis(t)
    money = ("total_revenue", "avg_ticket")
    text = row.select(*[F.col(c).cast("decimal(38,2)" if c in money else "bigint").cast("string").alias(c) for c in KPI_COLUMNS])
    long = text.unpivot([], KPI_COLUMNS, "metrica", "valor")
    return long.select(F.replace(F.col("metrica"), F.lit("_"), F.lit(" ")).alias("metrica"), "valor")


def abbreviate(amount: Column, ladder=LADDER_FULL) -> Column:
    """'1.2K' / '3M' / '4.5B' / 'T' with one decimal ('.0' dropped), else two decimals.

    ``amount`` must be an exact DECIMAL; scaling multiplies by 10^-k so the
    half-up rounding is exact.
    """
    out = F.round(amount, 2).cast("decimal(38,2)").cast("string")
    for threshold, suffix in reversed(ladder):
        scaled = F.round(amount * F.lit(Decimal(1) / Decimal(threshold)), 1).cast("decimal(38,1)").cast("string")
        out = F.when(amount >= F.lit(threshold), F.concat(F.regexp_replace(scaled, r"\.0$", ""), F.lit(suffix))).otherwise(out)
    return out


def abbreviate_amount(t: Tables) -> DataFrame:
    """Q60: monthly revenue (non-cancelled) with its dashboard abbreviation."""
    monthly = (
        t.orders.filter(F.col("status") != "Cancelado")
        .groupBy(F.trunc("order_date", "month").cast("timestamp_ntz").alias("month"))
        .agg(F.sum("total").alias("_rev"))
    )
    return monthly.select(
        "month",
        F.round("_rev", 2).cast("double").alias("revenue"),
        abbreviate(F.col("_rev"), LADDER_FULL).alias("formatted"),
        abbreviate(F.col("_rev"), LADDER_SHORT).alias("formatted_short"),
    )


def chart_series_monthly(t: Tables, months: int = CHART_MONTHS) -> DataFrame:
    """Q61: the last ``months`` months of revenue, oldest first, NULL revenue as 0."""
    last = reports.monthly_revenue(t).orderBy(F.col("month").desc()).limit(months)
    return last.select("month", F.coalesce(F.col("revenue"), F.lit(0.0)).alias("revenue")).orderBy("month")


def report_functions() -> dict[str, Callable[[Tables], DataFrame]]:
    return {
        "full": kpi_text,
        # the download re-sorts with a bare DESC: NULL revenue first (trap S3)
        "sales-by-category": lambda t: reports.sales_by_category(t).orderBy(
            F.col("revenue").desc_nulls_first(), "category_id"
        ),
        "top-products": reports.top_products,
        "customer-orders": lambda t: reports.customer_lifetime_value(t).orderBy(
            F.col("lifetime_value").desc_nulls_first(), "customer_id"
        ),
        "monthly-revenue": reports.monthly_revenue,
        "low-stock": reports.low_stock_products,
    }


def report(t: Tables, report_type: str | None = None) -> tuple[DataFrame, str]:
    """Q58: report type -> (frame, file name); blank -> 'full', unknown -> sales by category."""
    kind = (report_type or "").strip() or DEFAULT_REPORT
    if kind not in REPORT_FILES:
        kind = FALLBACK_REPORT
    return report_functions()[kind](t), REPORT_FILES[kind]


def report_registry(t: Tables) -> DataFrame:
    """Q58 as a table: every report type, its file name and its row count."""
    parts = []
    for kind, file_name in REPORT_FILES.items():
        df, _ = report(t, kind)
        parts.append(
            df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
                F.lit(kind).alias("report_type"), F.lit(file_name).alias("file_name"), "rows"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def export_csv(t: Tables, report_type: str = "sales-by-category") -> DataFrame:
    """Q56: a report rendered as CSV lines (every value quoted, NULL as "")."""
    df, _ = report(t, report_type)
    return csv_lines(df)


#: Reports of the JSON endpoints in their own order. Only the lifetime value is paged
#: (``export_json``); top products and monthly revenue end where their views do.
JSON_REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "sales-by-category": lambda t: reports.sales_by_category(t).orderBy(F.col("revenue").desc_nulls_first(), "category_id"),
    "top-products": reports.top_products,
    "pending-shipments": reports.pending_orders,
    "monthly-revenue": lambda t: reports.monthly_revenue(t).orderBy(F.col("month").desc()),
    "low-stock": lambda t: reports.low_stock_products(t).orderBy("stock", "product_id"),
    # dashboard parts, served the same way
    "kpis": reports.kpis,
    "payment-status": reports.payment_status_summary,
    "shipping-zones": reports.shipping_zone_revenue,
    "currencies": reports.sales_by_currency,
}


def export_json_report(t: Tables, report_type: str) -> DataFrame:
    """Q59 for the other endpoints: all rows of a report as JSON."""
    return json_lines(JSON_REPORTS[report_type](t))


def export_json(t: Tables, page: int = 1, limit: int = 20) -> DataFrame:
    """Q59: the lifetime-value page as JSON rows (the data part of the payload)."""
    return json_lines(customers.clv_page(t, page=page, limit=limit))
