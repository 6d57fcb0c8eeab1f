"""Order pricing and currency conversion.

All arithmetic is exact DECIMAL; a discount percentage is applied as
``subtotal * value * 0.01`` (a multiplication, so no division rounding) and
the stored amounts are rounded half-up to cents.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import money
from ..sources.literals import GTQ_TO_USD
from ..sources.tables import Tables

PERCENTAGE = "percentage"


def price_orders(t: Tables) -> DataFrame:
    """Q45: order subtotal from stored item prices, promotion discount and total.

    Percentage promotions discount a share of the subtotal; fixed ones a
    quetzal amount, converted when the order is in USD. Shipping, variant
    surcharges, minimum purchase and usage limits do not enter (as in the
    shop's pricing).
    """
    subtotal = t.order_items.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("subtotal")
    )
    promos = t.promotions.select("promo_id", "discount_type", "discount_value")
    rows = (
        t.orders.select("order_id", "currency_code", "promo_id")
        .join(subtotal, "order_id", "left")  # an order without lines costs nothing
        .withColumn("subtotal", F.coalesce("subtotal", F.lit(Decimal("0"))))
        .join(promos, "promo_id", "left")
    )
    fixed = F.when(
        F.col("currency_code") == "USD", F.col("discount_value") * F.lit(GTQ_TO_USD)
    ).otherwise(F.col("discount_value"))
    discount = (
        F.when(F.col("discount_type").isNull(), F.lit(Decimal("0")))
        .when(F.col("discount_type") == PERCENTAGE, F.col("subtotal") * F.col("discount_value") * F.lit(Decimal("0.01")))
        .otherwise(fixed)
    )
    return rows.select(
        "order_id",
        "currency_code",
        money("subtotal").alias("subtotal"),
        money(discount).alias("discount_applied"),
        money(F.col("subtotal") - discount).alias("total"),
    )


def to_usd(amount: str, currency: str | None = None, rate: Decimal = GTQ_TO_USD):
    """Column: amount in USD (quetzal amounts times ``rate``, USD amounts unchanged)."""
    a = F.col(amount)
    conv = a * F.lit(rate)
    return conv if currency is None else F.when(F.col(currency) == "GTQ", conv).otherwise(a)


def convert_currency(t: Tables, rate: Decimal = GTQ_TO_USD) -> DataFrame:
    """Q46: order totals converted to USD at the shop's display rate."""
    return t.orders.select(
        "order_id",
        "currency_code",
        money("total").alias("total"),
        money(to_usd("total", "currency_code", rate)).alias("amount_usd"),
    )
