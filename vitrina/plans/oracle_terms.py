"""Oracle SQL of promotion admission, dated rates, shipping quotes, the retention stream and the built indexes."""

from __future__ import annotations

from ..sources import literals
from . import oracle_catalog, oracle_people, oracle_reports  # noqa: F401  (statements used below)
from .oracle_sql import ORACLE, m, q, register


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


register(
    "promotion_admission",
    q(
        f"""SELECT order_id, promo_id, order_date, {m('subtotal')} AS subtotal,
                   reason IS NULL AND (max_uses IS NULL OR place <= max_uses) AS admitted,
                   CASE WHEN reason IS NOT NULL THEN reason WHEN place > max_uses THEN 'usage limit reached' END AS reason
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY promo_id, reason IS NULL ORDER BY order_date, order_id) AS place FROM judged) j""",
        f"""terms AS (
    SELECT promo_id, min_purchase, max_uses, CAST(valid_from AS TIMESTAMP) AS valid_from, CAST(valid_until AS TIMESTAMP) AS valid_until, is_active
    FROM (VALUES {_rows(literals.PROMOTION_TERMS)}) v(promo_id, min_purchase, max_uses, valid_from, valid_until, is_active)),
  spent AS (SELECT order_id, SUM(quantity * unit_price) AS amount FROM order_items GROUP BY order_id),
  judged AS (
    SELECT o.order_id, o.promo_id, o.order_date, p.max_uses, COALESCE(s.amount, 0) AS subtotal,
           CASE WHEN NOT p.is_active THEN 'promotion inactive' WHEN o.order_date < p.valid_from THEN 'not yet valid'
                WHEN o.order_date > p.valid_until THEN 'expired' WHEN COALESCE(s.amount, 0) < p.min_purchase THEN 'below the minimum purchase' END AS reason
    FROM shop_orders o JOIN terms p USING (promo_id) LEFT JOIN spent s USING (order_id) WHERE o.status <> 'Cancelado')""",
    ),
)

register(
    "dated_conversion",
    q(
        f"""SELECT o.order_id, o.currency_code, o.order_date, {m('o.total')} AS total,
                   CASE WHEN o.currency_code = 'USD' THEN 1.0::DOUBLE ELSE CAST(r.rate AS DOUBLE) END AS rate,
                   CASE WHEN o.currency_code = 'USD' THEN {m('o.total')} ELSE {m('CAST(o.total AS DECIMAL(18,2)) * CAST(r.rate AS DECIMAL(18,6))')} END AS amount_usd
            FROM shop_orders o ASOF LEFT JOIN latest r ON o.currency_code = r.from_currency AND o.order_date >= r.effective_date""",
        """came AS (
    SELECT order_id AS rate_id, 'GTQ' AS from_currency, CAST((1100 + order_id % 400) * 0.0001 AS DECIMAL(10,6)) AS rate, order_date AS effective_date
    FROM shop_orders WHERE order_id % 20 = 0 AND order_date >= TIMESTAMP '1993-01-01'),
  latest AS (SELECT from_currency, effective_date, arg_max(rate, rate_id) AS rate FROM came GROUP BY ALL)""",
    ),
)

register(
    "shipping_quotes",
    q(
        f"""SELECT order_id, CAST(weight AS DOUBLE) AS weight, zone_id, rate_id, {m('cost')} AS shipping_cost, days AS estimated_days
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY cost NULLS LAST, days, rate_id, zone_id) AS place FROM offers) x WHERE place = 1""",
        f"""rates AS (
    SELECT * FROM (VALUES {_rows(literals.SHIPPING_RATES)}) v(rate_id, zone_id, low, high, base, per_kg, days, active) WHERE active),
  weights AS (
    SELECT i.order_id, CAST(SUM(i.quantity * CAST((p.stock + 1) * 0.1 AS DECIMAL(10,2))) AS DECIMAL(18,2)) AS weight
    FROM order_items i JOIN products p USING (product_id) GROUP BY i.order_id),
  reach AS (
    SELECT DISTINCT a.address_id, z.zone_id FROM customer_addresses a JOIN cities t USING (city_id) JOIN countries n USING (country_id)
    JOIN shipping_zones z ON list_contains(z.countries, n.country_code)),
  sent AS (
    SELECT o.order_id, o.shipping_address_id AS address_id, COALESCE(w.weight, 0) AS weight
    FROM shop_orders o JOIN customer_addresses a ON a.address_id = o.shipping_address_id LEFT JOIN weights w USING (order_id)),
  offers AS (
    SELECT s.order_id, s.weight, f.zone_id, f.rate_id, f.days, ROUND(f.base + f.per_kg * s.weight, 2) AS cost
    FROM sent s LEFT JOIN (SELECT * FROM reach JOIN rates USING (zone_id)) f
      ON f.address_id = s.address_id AND s.weight >= f.low AND (f.high IS NULL OR s.weight < f.high))""",
    ),
)

# the stream ends where the batch rule does
register("retention_stream", ORACLE["retention_cleanup"])

register("search_indexed", ORACLE["search_products"])
register(
    "catalog_deep_page",
    q(f"SELECT {oracle_catalog.PRODUCT_OUT} FROM shelf WHERE is_active = true ORDER BY price ASC, product_id LIMIT 20 OFFSET 140", oracle_catalog.STOCK),
)
register(
    "active_customers",
    q(
        """SELECT kind, CASE kind WHEN 'all' THEN CAST(NULL AS TIMESTAMP) ELSE CAST(date_trunc(kind, order_date) AS TIMESTAMP) END AS start,
                  CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS customers
           FROM (SELECT *, unnest(['month', 'quarter', 'year', 'all']) AS kind FROM shop_orders WHERE status <> 'Cancelado' AND customer_id IS NOT NULL) o
           GROUP BY 1, 2""".replace("date_trunc(kind, order_date)", "CASE kind WHEN 'month' THEN date_trunc('month', order_date) WHEN 'quarter' THEN date_trunc('quarter', order_date) ELSE date_trunc('year', order_date) END")
    ),
)
register(
    "clv_deep_page",
    q(
        f"""SELECT {oracle_reports.VALUE_OUT} FROM (
              SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, customer_id) AS place FROM customer_values) v WHERE place BETWEEN 381 AND 400""",
        oracle_reports.VALUES,
    ),
)
register(
    "admin_deep_page",
    q(
        f"""SELECT product_id, product_name, {m('price')} AS price, stock, image_url, is_active, created_at, category_name,
                   available_stock AS total_stock, has_variants
            FROM shelf ORDER BY price DESC NULLS FIRST, product_id LIMIT 20 OFFSET 140""",
        oracle_catalog.STOCK,
    ),
)
