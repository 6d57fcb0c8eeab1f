"""Data-quality audits: the shop's CHECK / NOT NULL / FOREIGN KEY / UNIQUE
constraints turned into counting jobs, plus per-table row counts.

Each audit reads every table it needs once: a CHECK audit is one aggregate
with a conditional count per rule; the FK audit anti-joins the child keys of
each parent table once; the UNIQUE audit is one grouped count over tagged key tuples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import Tables

# --- fixed values -----------------------------------------------------------
ORDER_STATUSES = ["Pendiente", "Procesando", "Enviado", "Entregado", "Cancelado"]
SHIPPING_STATUSES = ["Preparando", "En tránsito", "Entregado", "Fallido"]
PAYMENT_STATUSES = ["Pendiente", "Aprobado", "Rechazado", "Reembolsado"]
DISCOUNT_TYPES = ["percentage", "fixed"]
# ---------------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(name)


def check_rules() -> list[tuple[str, str, Column]]:
    """(table, rule name, predicate). A row violates a CHECK when the predicate
    is FALSE (NULL passes, as in SQL); NOT NULL rules are explicit."""
    return [
        ("categories", "category_name not null", _c("category_name").isNotNull()),
        ("products", "product_name not null", _c("product_name").isNotNull()),
        ("products", "category_id not null", _c("category_id").isNotNull()),
        ("products", "price not null", _c("price").isNotNull()),
        ("products", "stock not null", _c("stock").isNotNull()),
        ("products", "price >= 0", _c("price") >= 0),
        ("products", "wholesale_price >= 0", _c("wholesale_price") >= 0),
        ("products", "stock >= 0", _c("stock") >= 0),
        ("product_variants", "stock >= 0", _c("stock") >= 0),
        ("product_variants", "stock not null", _c("stock").isNotNull()),
        ("product_reviews", "rating not null", _c("rating").isNotNull()),
        ("product_reviews", "rating between 1 and 5", _c("rating").between(1, 5)),
        ("customers", "email not null", _c("email").isNotNull()),
        ("customers", "first_name not null", _c("first_name").isNotNull()),
        ("customers", "last_name not null", _c("last_name").isNotNull()),
        ("orders", "total not null", _c("total").isNotNull()),
        ("orders", "total >= 0", _c("total") >= 0),
        ("orders", "status in domain", _c("status").isin(*ORDER_STATUSES)),
        ("orders", "shipping_status in domain", _c("shipping_status").isin(*SHIPPING_STATUSES)),
        ("orders", "currency_code length 3", F.length("currency_code") == 3),
        ("order_items", "quantity not null", _c("quantity").isNotNull()),
        ("order_items", "quantity > 0", _c("quantity") > 0),
        ("order_items", "unit_price >= 0", _c("unit_price") >= 0),
        ("payments", "amount not null", _c("amount").isNotNull()),
        ("payments", "amount > 0", _c("amount") > 0),
        ("payments", "status in domain", _c("status").isin(*PAYMENT_STATUSES)),
        ("cart_items", "quantity not null", _c("quantity").isNotNull()),
        ("cart_items", "quantity between 1 and 15", (_c("quantity") > 0) & (_c("quantity") <= 15)),
        ("cart_items", "session or customer present", _c("session_id").isNotNull() | _c("customer_id").isNotNull()),
        ("promotions", "discount_type in domain", _c("discount_type").isin(*DISCOUNT_TYPES)),
        ("promotions", "discount_value > 0", _c("discount_value") > 0),
    ]


def constraint_audit(t: Tables) -> DataFrame:
    """Q47: violations per CHECK / NOT NULL rule (rules with 0 included)."""
    by_table: dict[str, list[tuple[str, Column]]] = {}
    for table, rule, pred in check_rules():
        by_table.setdefault(table, []).append((rule, pred))
    parts = []
    for table, rules in by_table.items():
        counts = getattr(t, table).agg(
            *[F.count(F.when(~pred, 1)).cast("long").alias(f"r{i}") for i, (_, pred) in enumerate(rules)]
        )
        longs = counts.select(
            F.explode(
                F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (rule, _) in enumerate(rules)])
            ).alias("x")
        )
        parts.append(longs.select(F.lit(table).alias("table_name"), "x.rule", "x.violations"))
    return reduce(DataFrame.unionByName, parts)


def foreign_keys() -> list[tuple[str, str, str, str]]:
    """(child table, child column, parent table, parent column)."""
    return [
        ("cities", "country_id", "countries", "country_id"),
        ("customers", "city_id", "cities", "city_id"),
        ("customer_addresses", "customer_id", "customers", "customer_id"),
        ("customer_addresses", "city_id", "cities", "city_id"),
        ("products", "category_id", "categories", "category_id"),
        ("product_variants", "product_id", "products", "product_id"),
        ("product_reviews", "product_id", "products", "product_id"),
        ("product_reviews", "customer_id", "customers", "customer_id"),
        ("orders", "customer_id", "customers", "customer_id"),
        ("orders", "shipping_address_id", "customer_addresses", "address_id"),
        ("orders", "promo_id", "promotions", "promo_id"),
        ("order_items", "order_id", "orders", "order_id"),
        ("order_items", "product_id", "products", "product_id"),
        ("payments", "order_id", "orders", "order_id"),
        ("cart_items", "product_id", "products", "product_id"),
        ("cart_items", "customer_id", "customers", "customer_id"),
    ]


def referential_audit(t: Tables) -> DataFrame:
    """Q48: child rows whose non-NULL foreign key has no parent row.

    Foreign keys are numbered. For each parent table, the child keys of all its
    foreign keys are anti-joined once against its keys: small parents are broadcast
    by the planner's own size check, large ones take one shuffle in which a hot
    child key can be split. Only orphans are counted, by number; keys without
    orphans report 0.
    """
    fks = foreign_keys()
    orphans = []
    for parent, column in dict.fromkeys((p, pc) for _, _, p, pc in fks):
        keys = getattr(t, parent).select(F.col(column).cast("long").alias("_parent"))
        children = [
            getattr(t, child).select(F.lit(number).alias("fk"), F.col(c).cast("long").alias("_key"))
            for number, (child, c, p, pc) in enumerate(fks)
            if (p, pc) == (parent, column)
        ]
        rows = reduce(DataFrame.unionByName, children).filter(F.col("_key").isNotNull())
        orphans.append(rows.join(keys, F.col("_key") == F.col("_parent"), "left_anti").select("fk"))
    counts = reduce(DataFrame.unionByName, orphans).groupBy("fk").agg(F.count(F.lit(1)).alias("_n"))
    rules = [(number, child, f"{c} -> {p}.{pc}") for number, (child, c, p, pc) in enumerate(fks)]
    catalog = t.spark.createDataFrame(rules, "number int, table_name string, rule string")
    return catalog.join(counts, F.col("number") == F.col("fk"), "left").select(
        "table_name", "rule", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("violations")
    )


def unique_keys() -> list[tuple[str, list[str]]]:
    return [
        ("countries", ["country_code"]),
        ("countries", ["country_name"]),
        ("customers", ["email"]),
        ("customers", ["google_id"]),
        ("customers", ["facebook_id"]),
        ("categories", ["category_name"]),
        ("categories", ["slug"]),
        ("product_variants", ["sku"]),
        ("product_reviews", ["product_id", "customer_id"]),
        ("promotions", ["promo_code"]),
        ("orders", ["order_id"]),
    ]


def _key_numbers(df: DataFrame, cols: list[str]) -> Column:
    """Two 64-bit numbers that stand for a key: a one- or two-column integer key itself, any other by two hashes."""
    whole = all(isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for c in cols)
    if whole and len(cols) <= 2:
        numbers = [F.col(c).cast("long") for c in cols] + [F.lit(0).cast("long")]
        return F.struct(numbers[0].alias("a"), numbers[1].alias("b"))
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def uniqueness_audit(t: Tables) -> DataFrame:
    """Q49: number of key values held by more than one row (NULL keys excluded).

    All unique keys are checked in one grouped count: each table is read once, and a key
    is its rule's number and two 64-bit numbers, so that rows of fixed width are counted
    and shuffled whatever the key holds. Integer keys are exact; text keys are two
    independent hashes, which two different ones of n keys share with a chance of about
    n^2 / 2^129.
    """
    specs = unique_keys()
    rules = [(number, table, "unique(" + ", ".join(cols) + ")") for number, (table, cols) in enumerate(specs)]
    by_table: dict[str, list[tuple[int, list[str]]]] = {}
    for number, (table, cols) in enumerate(specs):
        by_table.setdefault(table, []).append((number, cols))
    parts = []
    for table, keys in by_table.items():
        df = getattr(t, table)
        known = lambda cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        tagged = F.array(*[F.when(known(cols), F.struct(F.lit(number).alias("number"), _key_numbers(df, cols).alias("key"))) for number, cols in keys])
        parts.append(df.select(F.explode(tagged).alias("x")).select("x.number", "x.key.a", "x.key.b"))
    dups = (
        reduce(DataFrame.unionByName, parts)
        .filter(F.col("number").isNotNull())
        .groupBy("number", "a", "b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .groupBy("number")
        .agg(F.count(F.lit(1)).alias("_v"))
    )
    catalog = t.spark.createDataFrame(rules, "_rule int, table_name string, rule string")
    return catalog.join(dups, F.col("_rule") == F.col("number"), "left").select(
        "table_name", "rule", F.coalesce(F.col("_v"), F.lit(0)).cast("long").alias("violations")
    )


def table_row_counts(t: Tables) -> DataFrame:
    """Q62: (tabla, registros) for every shop table."""
    parts = [
        getattr(t, name).agg(F.count(F.lit(1)).cast("long").alias("registros")).select(F.lit(name).alias("tabla"), "registros")
        for name in t.names()
    ]
    return reduce(DataFrame.unionByName, parts)
