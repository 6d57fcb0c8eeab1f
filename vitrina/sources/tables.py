"""Shop tables as Spark DataFrames.

``load(spark, path)`` reads the driver's TPC-H-shaped parquet tables and maps
them onto the shop schema (categories, products, orders, ...). Every mapped
table is a narrow projection/filter of one source scan (plus one small
DISTINCT for categories), so Catalyst prunes columns and pushes filters down
to the parquet scan of whatever a query actually touches.

``from_frames`` builds the same ``Tables`` from already-shaped frames (tests,
micro-fixtures, or a real shop export).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import literals

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Tables:
    categories: DataFrame
    products: DataFrame
    product_variants: DataFrame
    countries: DataFrame
    cities: DataFrame
    customers: DataFrame
    customer_addresses: DataFrame
    orders: DataFrame
    order_items: DataFrame
    payments: DataFrame
    product_reviews: DataFrame
    cart_items: DataFrame
    promotions: DataFrame
    shipping_zones: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]

    def replace(self, **frames: DataFrame) -> "Tables":
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        values.update(frames)
        return Tables(**values)


# Declared input schemas: reading with a schema skips footer-based inference
# (one footer read per file, which on a large table means a listing job).
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def read_source(spark: SparkSession, path: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SOURCE_SCHEMAS:
        reader = reader.schema(SOURCE_SCHEMAS[name])
    return reader.parquet(f"{path.rstrip('/')}/{name}.parquet")


def _mod(c: Column, n: int) -> Column:
    return c % F.lit(n)


def map_categories(part: DataFrame) -> DataFrame:
    """Distinct brands plus one category without products (id 99).

    The extra row is unioned *below* the aggregate, tagged so that it stays
    a separate row (UNION ALL semantics): the whole frame is then one
    shuffle stage whose measured size lets AQE broadcast it into every
    product join, instead of shuffling products by a ~25-value key.
    """
    brands = part.select(
        F.substring("p_brand", 7, 1 << 20).cast("int").alias("category_id"),
        F.col("p_brand").alias("category_name"),
        F.lower(F.regexp_replace("p_brand", "#", "-")).alias("slug"),
        F.lit(0).alias("_src"),
    )
    empty = part.sparkSession.createDataFrame(
        [(99, "Brand#99", "brand-99", 1)], "category_id int, category_name string, slug string, _src int"
    )
    return brands.unionByName(empty).distinct().drop("_src")


def map_products(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        key.alias("product_id"),
        # some names start with an accented or lower-case word, which sorts among the others
        F.concat(F.when(_mod(key, 37) == 0, "Ánfora ").when(_mod(key, 41) == 0, "zócalo ").otherwise(""), F.col("p_name")).alias("product_name"),
        F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("description"),
        F.substring("p_brand", 7, 1 << 20).cast("int").alias("category_id"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        (F.col("p_retailprice") * F.lit(0.8)).cast("decimal(10,2)").alias("wholesale_price"),
        (F.col("p_size") - 1).alias("stock"),
        (_mod(key, 20) != 0).alias("is_active"),
        F.date_add(F.lit("2024-01-01").cast("date"), _mod(key, 365).cast("int")).cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit("/img/p"), key.cast("string"), F.lit(".jpg")).alias("image_url"),
    )


def map_product_variants(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    i = F.col("i")
    exploded = part.filter(_mod(key, 3) == 0).select(
        key, "p_size", "p_name", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3, 4)])).alias("i")
    )
    size = F.when(i == 1, "S").when(i == 2, "M").when(i == 3, "L").otherwise("")
    return exploded.select(
        (key * 10 + i).alias("variant_id"),
        key.alias("product_id"),
        F.concat(F.col("p_name"), F.lit(" / "), i.cast("string")).alias("variant_name"),
        F.concat(F.lit("SKU-"), (key * 10 + i).cast("string")).alias("sku"),
        size.alias("size"),
        F.when(_mod(key, 4) == 0, F.lit(None).cast("string"))
        .when(i < 3, "Rojo")
        .otherwise("Azul")
        .alias("color"),
        F.when(i == 1, "Jade").when(i == 2, "Plata").when(i == 3, "").alias("material"),
        (i * 5).cast("decimal(10,2)").alias("additional_price"),
        ((F.col("p_size") * i) % 12).alias("stock"),
        ((_mod(key + i, 5) != 0) & (_mod(key, 9) != 0)).alias("is_active"),
    )


def map_countries(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_regionkey").alias("country_id"),
        F.substring("r_name", 1, 3).alias("country_code"),
        F.col("r_name").alias("country_name"),
    )


def map_cities(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").alias("city_id"),
        F.col("n_name").alias("city_name"),
        F.col("n_regionkey").alias("country_id"),
    )


def map_customers(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("customer_id"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.when(_mod(key, 97) == 0, F.lit(None).cast("string"))
        .otherwise(F.split_part("c_name", F.lit("#"), F.lit(2)))
        .alias("last_name"),
        F.when(_mod(key, 3) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("+502 "), key.cast("string")))
        .alias("phone"),
        F.when(_mod(key, 11) == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey")).alias("city_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), _mod(key, 365).cast("int"))
        .cast("timestamp_ntz")
        .alias("created_at"),
        F.when(_mod(key, 7) == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.date_add(F.lit("2023-01-01").cast("date"), (_mod(key, 365) + 30).cast("int")).cast("timestamp_ntz"))
        .alias("last_login"),
        F.when(_mod(key, 5) == 0, F.concat(F.lit("g"), key.cast("string"))).alias("google_id"),
        F.when(_mod(key, 13) == 0, F.concat(F.lit("f"), key.cast("string"))).alias("facebook_id"),
    )


def map_customer_addresses(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("address_id"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("city_id"),
    )


def map_orders(orders: DataFrame) -> DataFrame:
    okey, ckey, prio = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    status = (
        F.when(_mod(ckey, 211) == 5, "Cancelado")
        .when(prio == "1-URGENT", "Pendiente")
        .when(prio == "2-HIGH", "Procesando")
        .when(prio == "3-MEDIUM", "Enviado")
        .when(prio == "4-NOT SPECIFIED", "Entregado")
        .otherwise("Cancelado")
    )
    shipping = F.when(prio == "3-MEDIUM", "En tránsito").when(prio == "4-NOT SPECIFIED", "Entregado").otherwise("Preparando")
    return orders.select(
        okey.alias("order_id"),
        F.when((_mod(okey, 10) == 0) | (_mod(ckey, 50) == 0), F.lit(None).cast("long")).otherwise(ckey).alias("customer_id"),
        F.when(_mod(okey, 7) == 0, F.lit(None).cast("long")).otherwise(ckey).alias("shipping_address_id"),
        F.col("o_orderdate").alias("order_date"),
        status.alias("status"),
        shipping.alias("shipping_status"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total"),
        F.when(F.col("o_orderstatus") == "P", "USD").otherwise("GTQ").alias("currency_code"),
        F.when(_mod(okey, 3) == 0, _mod(okey, 4) + 1).alias("promo_id"),
        F.concat(F.lit("guest"), okey.cast("string"), F.lit("@example.org")).alias("guest_email"),
        F.when(_mod(okey, 20) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Guest "), okey.cast("string")))
        .alias("guest_name"),
    )


def map_order_items(lineitem: DataFrame) -> DataFrame:
    """Every line; lines of products divisible by 13 count for the next product, so some stay unsold."""
    key = F.col("l_partkey")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.when(_mod(key, 13) == 0, key + 1).otherwise(key).alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(10,2)").alias("unit_price"),
    )


def map_payments(lineitem: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    """Every line is paid for on its own."""
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("amount"),
        F.when(flag == "A", "Aprobado").when(flag == "N", "Pendiente").otherwise("Reembolsado").alias("status"),
    )


def map_product_reviews(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    return events.select(
        eid.alias("review_id"),
        _mod(eid, 200).alias("product_id"),
        F.when(_mod(eid, 11) == 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("customer_id"),
        (_mod(eid, 5) + 1).cast("int").alias("rating"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("review_text"),
        (_mod(eid, 2) == 0).alias("is_verified_purchase"),
        (F.col("event_type") != "error").alias("is_approved"),
        F.col("ts").alias("created_at"),
    )


def map_cart_items(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    guest = _mod(uid, 4) == 0
    return events.select(
        eid.alias("id"),
        F.when(guest, F.concat(F.lit("s"), uid.cast("string"))).alias("session_id"),
        F.when(guest, F.lit(None).cast("long")).otherwise(uid).alias("customer_id"),
        # one line in fifty is for a product that does not exist
        (F.substr(F.col("props"), F.lit(7), F.length("props") - 7).cast("int") + F.when(_mod(eid, 50) == 7, 9_000_000).otherwise(0)).alias("product_id"),
        (_mod(eid, 15) + 1).cast("int").alias("quantity"),
        F.when(_mod(eid, 3) == 0, "").otherwise("M").alias("size"),
        F.lit("").alias("color"),
        F.col("ts").alias("updated_at"),
    )


def load(spark: SparkSession, path: str) -> Tables:
    """Map the driver tables under ``path`` onto the shop schema (lazy)."""
    src = {name: read_source(spark, path, name) for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events")}
    return Tables(
        categories=map_categories(src["part"]),
        products=map_products(src["part"]),
        product_variants=map_product_variants(src["part"]),
        countries=map_countries(src["region"]),
        cities=map_cities(src["nation"]),
        customers=map_customers(src["customer"]),
        customer_addresses=map_customer_addresses(src["customer"]),
        orders=map_orders(src["orders"]),
        order_items=map_order_items(src["lineitem"]),
        payments=map_payments(src["lineitem"]),
        product_reviews=map_product_reviews(src["events"]),
        cart_items=map_cart_items(src["events"]),
        promotions=literals.promotions(spark),
        shipping_zones=literals.shipping_zones(spark),
    )
