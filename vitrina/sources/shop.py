"""Sources for data that is already in the shop's shape.

``load_export`` reads one directory (or file) per shop table, e.g. a
parquet export of the shop database, and ``load_jdbc`` reads the tables
straight from the database with partitioned, parallel JDBC scans. Both
return the same ``Tables`` every report takes, so the reports run unchanged
on real shop data. Columns are selected by name, so extra columns in the
source are pruned at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

# Columns each report set reads, per shop table (name -> Spark type).
SHOP_SCHEMA: dict[str, list[tuple[str, str]]] = {
    "categories": [("category_id", "int"), ("category_name", "string"), ("slug", "string")],
    "products": [
        ("product_id", "bigint"), ("product_name", "string"), ("description", "string"), ("category_id", "int"),
        ("price", "decimal(10,2)"), ("wholesale_price", "decimal(10,2)"), ("stock", "int"), ("is_active", "boolean"),
        ("created_at", "timestamp_ntz"), ("image_url", "string"),
    ],
    "product_variants": [
        ("variant_id", "bigint"), ("product_id", "bigint"), ("variant_name", "string"), ("sku", "string"),
        ("size", "string"), ("color", "string"), ("material", "string"), ("additional_price", "decimal(10,2)"),
        ("stock", "int"), ("is_active", "boolean"),
    ],
    "countries": [("country_id", "int"), ("country_code", "string"), ("country_name", "string")],
    "cities": [("city_id", "int"), ("city_name", "string"), ("country_id", "int")],
    "customers": [
        ("customer_id", "bigint"), ("email", "string"), ("first_name", "string"), ("last_name", "string"),
        ("phone", "string"), ("city_id", "int"), ("created_at", "timestamp_ntz"), ("last_login", "timestamp_ntz"),
        ("google_id", "string"), ("facebook_id", "string"),
    ],
    "customer_addresses": [("address_id", "bigint"), ("customer_id", "bigint"), ("city_id", "int")],
    "orders": [
        ("order_id", "bigint"), ("customer_id", "bigint"), ("shipping_address_id", "bigint"),
        ("order_date", "timestamp_ntz"), ("status", "string"), ("shipping_status", "string"),
        ("total", "decimal(10,2)"), ("currency_code", "string"), ("promo_id", "bigint"), ("guest_email", "string"),
        ("guest_name", "string"),
    ],
    "order_items": [
        ("order_id", "bigint"), ("line_no", "int"), ("product_id", "bigint"), ("quantity", "int"),
        ("unit_price", "decimal(10,2)"),
    ],
    "payments": [("order_id", "bigint"), ("amount", "decimal(10,2)"), ("status", "string")],
    "product_reviews": [
        ("review_id", "bigint"), ("product_id", "bigint"), ("customer_id", "bigint"), ("rating", "int"),
        ("review_text", "string"), ("is_verified_purchase", "boolean"), ("is_approved", "boolean"),
        ("created_at", "timestamp_ntz"),
    ],
    "cart_items": [
        ("id", "bigint"), ("session_id", "string"), ("customer_id", "bigint"), ("product_id", "int"),
        ("quantity", "int"), ("size", "string"), ("color", "string"), ("updated_at", "timestamp_ntz"),
    ],
    "promotions": [
        ("promo_id", "int"), ("promo_code", "string"), ("discount_type", "string"), ("discount_value", "decimal(10,2)"),
    ],
    "shipping_zones": [("zone_id", "int"), ("zone_name", "string"), ("countries", "array<string>")],
}

# Descriptive columns a source may lack; keys, measures, states and times must be there.
OPTIONAL = frozenset("description image_url variant_name sku material phone last_login google_id facebook_id review_text guest_name".split())

# Key column used to split each table's JDBC scan into parallel ranges.
JDBC_SPLIT_KEYS = {
    "products": "product_id",
    "product_variants": "variant_id",
    "customers": "customer_id",
    "customer_addresses": "address_id",
    "orders": "order_id",
    "order_items": "order_id",
    "payments": "order_id",
    "product_reviews": "review_id",
    "cart_items": "id",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the table's shop columns (by name) with the shop types.

    A column of ``OPTIONAL`` that the source lacks becomes NULL; any other raises.
    """
    have = {c.lower(): c for c in df.columns}
    missing = [name for name, _ in SHOP_SCHEMA[table] if name not in have and name not in OPTIONAL]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(*((F.col(have[name]) if name in have else F.lit(None)).cast(dtype).alias(name) for name, dtype in SHOP_SCHEMA[table]))


def load_export(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> Tables:
    """Shop tables from ``<path>/<table>`` in ``fmt`` (parquet, orc, json, ...)."""
    frames = {}
    for table in SHOP_SCHEMA:
        df = spark.read.format(fmt).options(**options).load(f"{path.rstrip('/')}/{table}")
        frames[table] = conform(df, table)
    return Tables(**frames)


def load_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    partitions: int = 64,
    bounds: dict[str, tuple[int, int]] | None = None,
) -> Tables:
    """Shop tables read over JDBC; large tables are split into ``partitions``
    parallel range scans on their key (``bounds`` gives each key's range, and
    must name all of ``JDBC_SPLIT_KEYS``: one connection cannot read them)."""
    unbounded = sorted(set(JDBC_SPLIT_KEYS) - set(bounds or {}))
    if unbounded:
        raise ValueError(f"bounds are needed for {', '.join(unbounded)}")
    frames = {}
    for table in SHOP_SCHEMA:
        key = JDBC_SPLIT_KEYS.get(table)
        if key:
            lo, hi = bounds[table]
            df = spark.read.jdbc(url, table, column=key, lowerBound=lo, upperBound=hi, numPartitions=partitions,
                                 properties=properties)
        else:
            df = spark.read.jdbc(url, table, properties=properties)
        frames[table] = conform(df, table)
    return Tables(**frames)
