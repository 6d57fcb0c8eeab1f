"""Promotion admission, dated exchange rates and shipping quotes.

These read tables that the shop's schema declares for the purpose: promotion terms,
exchange rates by date, and shipping rates by zone and weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import money, not_cancelled
from ..sources import literals
from ..sources.tables import Tables
from .reports import zone_cities

# --- fixed values -----------------------------------------------------------
ADMITTED = "admitted"
REASON_INACTIVE = "promotion inactive"
REASON_EARLY = "not yet valid"
REASON_LATE = "expired"
REASON_MINIMUM = "below the minimum purchase"
REASON_USED_UP = "usage limit reached"
# ---------------------------------------------------------------------------

#: Order ids that one block of the last counting level holds.
ID_BLOCK = 4096
#: Parts that the orders of one currency and day are spread over.
SALTS = 8
#: Width of a weight cell in kg.
CELL = 50


def first_uses(rows: DataFrame, key: str, quota: str, levels: list[Column], order: list[str]) -> DataFrame:
    """``rows`` with ``first``: is the row among the first ``quota`` (null: any number) of its key, by ``levels``, then ``order``?

    Levels are ever finer buckets that follow the order. At each, the buckets of a key are
    counted (map-side sums), and running sums over the counts decide for whole buckets;
    only the bucket in which the quota ends goes on to the next level. A number is given
    to single rows in the last such bucket alone, so no window holds the rows of a key.
    """
    rest = rows.withColumns({f"_l{k}": level for k, level in enumerate(levels)}).withColumn("_left", F.col(quota).cast("long"))
    decided = []
    for k in range(len(levels)):
        names = [f"_l{j}" for j in range(k + 1)]
        counts = rest.groupBy(key, *names).agg(F.count("*").alias("_n"))
        before = Window.partitionBy(key, *names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(
            F.col(key).alias("_key"), *(F.col(n).alias(f"{n}o") for n in names), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
        )
        rest = rest.join(counts, [F.col(key) == F.col("_key"), *(F.col(n).eqNullSafe(F.col(f"{n}o")) for n in names)])
        whole = F.col("_left").isNull() | (F.col("_before") + F.col("_n") <= F.col("_left"))
        none = F.coalesce(F.col("_before") >= F.col("_left"), F.lit(False))
        decided.append(rest.filter(whole | none).select(*rows.columns, whole.alias("first")))
        rest = rest.filter(~(whole | none)).withColumn("_left", F.col("_left") - F.col("_before")).drop("_key", "_n", "_before", *(f"{n}o" for n in names))
    number = F.row_number().over(Window.partitionBy(key, *(f"_l{j}" for j in range(len(levels)))).orderBy(*order))
    out = rest.select(*rows.columns, (number <= F.col("_left")).alias("first"))
    for part in decided:
        out = out.union(part)
    return out


def promotion_admission(t: Tables, terms: DataFrame | None = None) -> DataFrame:
    """Every order with a promotion code: is the promotion admitted, and if not, why.

    An order counts if it isn't cancelled, the code is active, the order date lies in the
    code's time and its subtotal reaches the minimum. Of these, in order of date and id,
    the first ``max_uses`` are admitted. Orders of unknown codes do not appear.
    """
    if terms is None:
        terms = literals.promotion_terms(t.spark)
    terms = terms.select(F.col("promo_id").alias("_promo"), "min_purchase", "max_uses", "valid_from", "valid_until", "is_active")
    subtotal = t.order_items.groupBy(F.col("order_id").alias("_order")).agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("subtotal"))
    rows = (
        t.orders.filter(F.col("promo_id").isNotNull() & not_cancelled())
        .select("order_id", "promo_id", "order_date")
        .join(terms, F.col("promo_id") == F.col("_promo"))
        .join(subtotal, F.col("order_id") == F.col("_order"), "left")
        .withColumn("subtotal", F.coalesce(F.col("subtotal"), F.lit(0)))
    )
    reason = (
        F.when(~F.coalesce(F.col("is_active"), F.lit(False)), REASON_INACTIVE)
        .when(F.coalesce(F.col("order_date") < F.col("valid_from"), F.lit(False)), REASON_EARLY)
        .when(F.coalesce(F.col("order_date") > F.col("valid_until"), F.lit(False)), REASON_LATE)
        .when(F.coalesce(F.col("subtotal") < F.col("min_purchase"), F.lit(False)), REASON_MINIMUM)
    )
    rows = rows.select("order_id", "promo_id", "order_date", "max_uses", money("subtotal").alias("subtotal"), reason.alias("reason"))
    levels = [F.trunc("order_date", "month"), F.col("order_date"), F.floor(F.col("order_id") / F.lit(ID_BLOCK))]
    ranked = first_uses(rows.filter(F.col("reason").isNull()), "promo_id", "max_uses", levels, ["order_id"])
    ranked = ranked.withColumn("reason", F.when(~F.col("first"), REASON_USED_UP)).drop("first")
    return ranked.union(rows.filter(F.col("reason").isNotNull())).select(
        "order_id", "promo_id", "order_date", "subtotal", F.col("reason").isNull().alias(ADMITTED), "reason"
    )


def exchange_rates(t: Tables) -> DataFrame:
    """Rates to the dollar as they came in, derived from the orders (every twentieth sets one; some on the same date)."""
    rate = F.expr("CAST((1100 + order_id % 400) * 0.0001 AS DECIMAL(10,6))")
    return t.orders.filter((F.col("order_id") % 20 == 0) & (F.col("order_date") >= F.lit("1993-01-01").cast("timestamp_ntz"))).select(
        F.col("order_id").alias("rate_id"), F.lit("GTQ").alias("from_currency"), F.lit("USD").alias("to_currency"), rate.alias("rate"), F.col("order_date").alias("effective_date")
    )


def rate_at(rows: DataFrame, currency: str, at: str, rates: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``rate``: the latest one of the row's currency that took effect at or before the row's time.

    An as-of join without a range join: rates and rows are united and, inside a (currency,
    day, salt), a running last value gives each row the rate before it. What came before
    the day is carried in: the last rate of each day, running over the days. Rows are
    spread over ``salts`` parts (rates are copied to each), so neither a currency nor a day
    is one group. Of several rates of one moment the highest id counts; before the first
    rate it is null.
    """
    latest = rates.groupBy("from_currency", "effective_date").agg(F.max_by("rate", "rate_id").alias("rate")).filter(F.col("effective_date").isNotNull())
    day = lambda c: F.date_trunc("day", F.col(c)).cast("timestamp_ntz")
    body = F.struct(*rows.columns)
    salt = F.abs(F.xxhash64(body) % salts).cast("int")
    left = rows.select(F.col(currency).alias("_c"), F.col(at).alias("_at"), day(at).alias("_day"), salt.alias("_salt"), F.lit(1).alias("_tag"), F.lit(None).cast(latest.schema["rate"].dataType).alias("_rate"), body.alias("_row"))
    right = latest.select(
        F.col("from_currency").alias("_c"), F.col("effective_date").alias("_at"), day("effective_date").alias("_day"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(0).alias("_tag"), F.col("rate").alias("_rate"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
    )
    up_to = Window.partitionBy("_c", "_day", "_salt").orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = left.union(right).withColumn("_inside", F.last("_rate", ignorenulls=True).over(up_to)).filter("_tag = 1")
    ends = latest.groupBy(F.col("from_currency").alias("_kc"), day("effective_date").alias("_kd")).agg(F.max_by("rate", "effective_date").alias("_end"))
    days = left.select(F.col("_c").alias("_kc"), F.col("_day").alias("_kd")).distinct()
    before = Window.partitionBy("_kc").orderBy("_kd").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.unionByName(days.withColumn("_end", F.lit(None).cast(latest.schema["rate"].dataType)))
        .groupBy("_kc", "_kd")
        .agg(F.max("_end").alias("_end"))
        .withColumn("_carried", F.last("_end", ignorenulls=True).over(before))
        .select("_kc", "_kd", "_carried")
    )
    out = inside.join(carried, (F.col("_c") == F.col("_kc")) & (F.col("_day") == F.col("_kd")), "left")
    return out.select("_row.*", F.coalesce("_inside", "_carried").alias("rate"))


def dated_conversion(t: Tables, rates: DataFrame | None = None, to: str = "USD") -> DataFrame:
    """Order totals in dollars at the rate of the order's date (Q46 has the constant the storefront shows).

    Null before the first rate of the currency.
    """
    if rates is None:
        rates = exchange_rates(t)
    orders = t.orders.select("order_id", "currency_code", "order_date", "total")
    rows = rate_at(orders, "currency_code", "order_date", rates.filter(F.col("to_currency") == to))
    rate = F.when(F.col("currency_code") == to, F.lit(1).cast("decimal(10,6)")).otherwise(F.col("rate"))
    return rows.select("order_id", "currency_code", "order_date", money("total").alias("total"), rate.cast("double").alias("rate"), money(F.col("total") * rate).alias("amount_usd"))


def order_weights(t: Tables) -> DataFrame:
    """(order_id, weight) in kg; a product weighs a tenth of its size (the size is its first stock plus one)."""
    weight = ((F.col("stock") + 1) * F.lit(0.1).cast("decimal(3,1)")).cast("decimal(10,2)")
    products = t.products.select("product_id", weight.alias("_kg"))
    return t.order_items.join(products, "product_id").groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("_kg")).cast("decimal(18,2)").alias("weight"))


def shipping_quotes(t: Tables, rates: DataFrame | None = None, cell: int = CELL) -> DataFrame:
    """The cheapest shipping rate of every order with an address: its zone's bands by weight.

    A band holds weights from its minimum (inclusive) to its maximum (exclusive; null: no
    end). Bands are spread over cells of ``cell`` kg, and orders meet them by zone and
    cell (an equi-join), then by the exact bounds. A zone's last cell, where its last bound
    lies, takes everything above, so that open bands end there. Of equal costs the
    quicker, then the lower id counts; without a band the quote is null.
    """
    if rates is None:
        rates = literals.shipping_rates(t.spark)
    rates = rates.filter("is_active")
    cell_of = lambda c: F.floor(c / F.lit(cell)).cast("long")
    last = rates.groupBy(F.col("zone_id").alias("_z")).agg(cell_of(F.max(F.greatest("min_weight", F.coalesce("max_weight", "min_weight")))).alias("_last"))
    low, high = cell_of(F.col("min_weight")), F.coalesce(cell_of(F.col("max_weight")), F.col("_last"))
    bands = rates.join(last, F.col("zone_id") == F.col("_z")).withColumn("_cell", F.explode(F.sequence(low, high))).drop("_z", "_last").withColumnRenamed("zone_id", "_zone")
    zones = zone_cities(t).filter(F.col("city_id").isNotNull()).select("zone_id", F.col("city_id").alias("_city")).distinct()
    zones = zones.join(last, F.col("zone_id") == F.col("_z")).drop("_z")
    addresses = t.customer_addresses.select(F.col("address_id").alias("_address"), F.col("city_id").alias("_of"))
    orders = (
        t.orders.filter(F.col("shipping_address_id").isNotNull())
        .select("order_id", "shipping_address_id")
        .join(addresses, F.col("shipping_address_id") == F.col("_address"))
        .join(order_weights(t).withColumnRenamed("order_id", "_order"), F.col("order_id") == F.col("_order"), "left")
        .select("order_id", F.coalesce(F.col("weight"), F.lit(0)).cast("decimal(18,2)").alias("weight"), "_of")
    )
    placed = orders.join(zones, F.col("_of") == F.col("_city"), "left").withColumn("_at", F.least(cell_of(F.col("weight")), F.col("_last")))
    fits = (
        (F.col("zone_id") == F.col("_zone"))
        & (F.col("_at") == F.col("_cell"))
        & (F.col("weight") >= F.col("min_weight"))
        & (F.col("max_weight").isNull() | (F.col("weight") < F.col("max_weight")))
    )
    cost = F.round(F.col("base_cost") + F.col("cost_per_kg") * F.col("weight"), 2)
    offer = F.when(F.col("rate_id").isNotNull(), F.struct(cost.alias("cost"), F.col("estimated_days").alias("days"), F.col("rate_id").alias("rate"), F.col("zone_id").alias("zone")))
    best = placed.join(bands, fits, "left").groupBy("order_id", "weight").agg(F.min(offer).alias("best"))
    return best.select(
        "order_id", F.col("weight").cast("double").alias("weight"), F.col("best.zone").alias("zone_id"), F.col("best.rate").alias("rate_id"),
        money("best.cost").alias("shipping_cost"), F.col("best.days").alias("estimated_days"),
    )
