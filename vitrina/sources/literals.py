"""Small literal dimension tables.

They are built from the Python lists below, so the planner knows their
exact size and broadcasts them by its own size check; no hint is needed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Promotions of the shop (id, code, discount type, discount value).
PROMOTIONS = [
    (1, "PROMO-A", "percentage", Decimal("15.00")),
    (2, "PROMO-B", "percentage", Decimal("10.00")),
    (3, "PROMO-C", "fixed", Decimal("50.00")),
    (4, "PROMO-D", "percentage", Decimal("20.00")),
]

# Terms of the promotions: id, minimum purchase, most uses (None: any number), valid from, valid until, active.
PROMOTION_TERMS = [
    (1, Decimal("0.00"), 300, "1994-01-01 00:00:00", None, True),
    (2, Decimal("90000.00"), None, "1992-01-01 00:00:00", "1999-06-30 00:00:00", True),
    (3, Decimal("50000.00"), 400, None, "2001-03-01 00:00:00", True),
    (4, Decimal("0.00"), 100, None, None, False),
]

# Shipping rates: id, zone, weight from (inclusive) and to (exclusive, None: no end) in kg, base cost, cost per kg, days, active.
# Zone 2 has overlapping bands, zone 3 a gap.
SHIPPING_RATES = [
    (1, 1, Decimal("0.00"), Decimal("100.00"), Decimal("25.00"), Decimal("0.50"), 3, True),
    (2, 1, Decimal("100.00"), Decimal("400.00"), Decimal("60.00"), Decimal("0.35"), 5, True),
    (3, 1, Decimal("400.00"), None, Decimal("120.00"), Decimal("0.20"), 8, True),
    (4, 2, Decimal("0.00"), Decimal("250.50"), Decimal("40.00"), Decimal("0.90"), 6, True),
    (5, 2, Decimal("180.00"), None, Decimal("95.00"), Decimal("0.60"), 12, True),
    (6, 2, Decimal("0.00"), None, Decimal("1.00"), Decimal("0.01"), 30, False),
    (7, 3, Decimal("0.00"), Decimal("150.00"), Decimal("55.00"), Decimal("1.10"), 7, True),
    (8, 3, Decimal("300.00"), Decimal("900.00"), Decimal("140.00"), Decimal("0.80"), 14, True),
]

# Shipping zones (id, name, country codes). Zona B repeats a code on purpose
# (it must not duplicate rows), Zona D matches no country.
SHIPPING_ZONES = [
    (1, "Zona A", ["AFR"]),
    (2, "Zona B", ["AME", "ASI", "AME"]),
    (3, "Zona C", ["EUR", "MID"]),
    (4, "Zona D", ["ZZZ"]),
]

# Category slugs the storefront routes understand (slug -> category name).
CATEGORY_SLUGS = {
    "joyeria": "Joyería",
    "joyeria-plata": "Joyería de Plata",
    "joyeria-jade": "Joyería de Jade",
    "ceramica": "Cerámica",
    "ceramica-vidriada": "Cerámica Vidriada",
    "ceramica-decorativa": "Cerámica Decorativa",
    "textiles": "Textiles",
    "textiles-mayas": "Textiles Mayas",
    "huipiles": "Huipiles",
    "cortes": "Cortes",
    "ropa": "Ropa",
    "mascaras": "Máscaras",
    "madera-tallada": "Madera Tallada",
    "decoracion-hogar": "Decoración del Hogar",
    "bolsas-accesorios": "Bolsas y Accesorios",
}

# Display conversion rate quetzal -> US dollar.
GTQ_TO_USD = Decimal("0.128")

# Flat shipping charged on a non-empty cart.
FLAT_SHIPPING = Decimal("25.00")

# Cart limits: quantity per line and distinct products per cart.
MAX_LINE_QTY = 15
MAX_CART_PRODUCTS = 50

# Order statuses.
CANCELLED = "Cancelado"
OPEN_STATUSES = ["Pendiente", "Procesando"]
# ---------------------------------------------------------------------------

PROMOTIONS_SCHEMA = T.StructType(
    [
        T.StructField("promo_id", T.IntegerType(), False),
        T.StructField("promo_code", T.StringType(), False),
        T.StructField("discount_type", T.StringType(), False),
        T.StructField("discount_value", T.DecimalType(10, 2), False),
    ]
)

ZONES_SCHEMA = T.StructType(
    [
        T.StructField("zone_id", T.IntegerType(), False),
        T.StructField("zone_name", T.StringType(), False),
        T.StructField("countries", T.ArrayType(T.StringType()), True),
    ]
)

SLUGS_SCHEMA = T.StructType(
    [
        T.StructField("route_slug", T.StringType(), False),
        T.StructField("route_category_name", T.StringType(), False),
    ]
)


def promotions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMOTIONS, PROMOTIONS_SCHEMA)


def promotion_terms(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        PROMOTION_TERMS, "promo_id int, min_purchase decimal(10,2), max_uses int, valid_from string, valid_until string, is_active boolean"
    )
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_until")})


def shipping_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SHIPPING_RATES,
        "rate_id int, zone_id int, min_weight decimal(10,2), max_weight decimal(10,2), base_cost decimal(10,2), cost_per_kg decimal(10,2), estimated_days int, is_active boolean",
    )


def shipping_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHIPPING_ZONES, ZONES_SCHEMA)


def category_slugs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CATEGORY_SLUGS.items()), SLUGS_SCHEMA)
