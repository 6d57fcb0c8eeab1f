"""Oracle SQL for customer and cart queries."""

from __future__ import annotations

from .oracle_reports import VALUE_OUT, VALUES
from .oracle_sql import m, q, register

register(
    "customer_profile",
    q(
        """SELECT u.customer_id, u.first_name, u.last_name, u.email, u.phone, u.created_at, u.last_login, h.city_name, h.country_name
           FROM customers u LEFT JOIN homes h USING (city_id)""",
        "homes AS (SELECT t.city_id, t.city_name, n.country_name FROM cities t LEFT JOIN countries n USING (country_id))",
    ),
)

register(
    "customer_order_stats",
    q(
        f"""SELECT u.customer_id, CAST(COALESCE(s.n, 0) AS BIGINT) AS total_orders, {m('COALESCE(s.amount, 0)')} AS total_spent
            FROM customers u LEFT JOIN spent s USING (customer_id)""",
        "spent AS (SELECT customer_id, COUNT(*) AS n, SUM(total) AS amount FROM shop_orders WHERE status <> 'Cancelado' GROUP BY customer_id)",
    ),
)

register(
    "customer_recent_orders",
    q(
        f"""SELECT customer_id, order_id, order_date, {m('total')} AS total, status, currency_code, rn FROM (
              SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id) AS INTEGER) rn
              FROM shop_orders WHERE customer_id IS NOT NULL) t
            WHERE rn <= 5"""
    ),
)

register(
    "clv_page",
    q(
        f"""SELECT {VALUE_OUT} FROM (
              SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, customer_id) AS place FROM customer_values) v
            WHERE place BETWEEN 21 AND 40""",
        VALUES,
    ),
)

register(
    "clv_page_meta",
    q(
        """SELECT 2 AS page, 20 AS "limit", CAST(COUNT(*) AS BIGINT) AS total,
                  CAST(ceil(COUNT(*) / 20.0) AS BIGINT) AS total_pages FROM customer_values""",
        VALUES,
    ),
)

#: Lines of registered customers on active products.
_BOUGHT = """bought AS (
    SELECT l.*, g.product_name, g.price, g.image_url, g.stock, g.category_id, g.price * l.quantity AS amount
    FROM (SELECT id, customer_id, quantity, size, color, CAST(product_id AS BIGINT) AS product_id FROM cart_items WHERE customer_id IS NOT NULL) l
    JOIN (SELECT * FROM products WHERE is_active) g USING (product_id))"""

register(
    "cart_contents",
    q(
        f"""SELECT b.id, b.customer_id, b.quantity, b.size, b.color, b.product_id, b.product_name, {m('b.price')} AS price,
                   b.image_url, b.stock, k.category_name, {m('b.amount')} AS item_total
            FROM bought b LEFT JOIN categories k USING (category_id)""",
        _BOUGHT,
    ),
)

register(
    "cart_totals",
    q(
        f"""SELECT customer_id, {m('SUM(amount)')} AS subtotal, 25.0::DOUBLE AS shipping, {m('SUM(amount) + 25')} AS total
            FROM bought GROUP BY customer_id""",
        _BOUGHT,
    ),
)

_OWNER = """CASE WHEN customer_id IS NOT NULL THEN 'customer' ELSE 'session' END AS owner_type,
            COALESCE(CAST(customer_id AS VARCHAR), session_id) AS owner_id"""

register(
    "cart_item_count",
    q(
        """SELECT owner_type, owner_id, CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS count FROM (
              SELECT {o}, quantity FROM cart_items
              UNION ALL
              SELECT 'customer', CAST(customer_id AS VARCHAR), NULL FROM customers) t
            GROUP BY owner_type, owner_id""".format(o=_OWNER)
    ),
)

register(
    "cart_distinct_products",
    q(
        f"""SELECT {_OWNER}, CAST(COUNT(DISTINCT product_id) AS BIGINT) AS distinct_products,
                   COUNT(DISTINCT product_id) >= 50 AS at_limit
            FROM cart_items GROUP BY 1, 2"""
    ),
)

_LINE_OWNERS = """line_owners AS (
    SELECT id, 'customer' AS owner_type, CAST(customer_id AS VARCHAR) AS owner_id FROM cart_items WHERE customer_id IS NOT NULL
    UNION ALL
    SELECT id, 'session', session_id FROM cart_items WHERE session_id IS NOT NULL)"""

def _cart_job(batch: str, top: int | None) -> str:
    """The cart rules request by request: each request sees the line as the ones before it left it."""
    invalid = "q IS NULL OR q < 1" + (" OR q > 15" if top else "")
    # a cart is full once its products and the new ones born before the request reach the limit
    full = f"COALESCE(h.n, 0) + (SELECT COUNT(*) FROM newest w WHERE w.owner_type = r.owner_type AND w.owner_id = r.owner_id AND w.birth < r.moment) >= {top}" if top else "FALSE"
    return q(
        """SELECT owner_type, owner_id, product_id, size, color, MIN(line_id) AS line_id, CAST(MIN(old) AS INTEGER) AS old_quantity,
                  CAST(CASE WHEN COUNT(*) FILTER (counted) > 0 THEN LEAST(COALESCE(MIN(old), 0) + SUM(q) FILTER (counted), 15, MIN(stock)) END AS INTEGER) AS new_quantity,
                  CAST(COUNT(*) AS BIGINT) AS requests, CAST(COUNT(*) FILTER (counted) AS BIGINT) AS accepted,
                  CASE WHEN COUNT(*) FILTER (counted) > 0 THEN CASE WHEN MIN(line_id) IS NULL THEN 'insert' ELSE 'update' END
                       WHEN arg_max(why, moment) IN ('unknown product', 'inactive product') THEN 'skip' ELSE 'reject' END AS action,
                  CASE WHEN COUNT(*) FILTER (counted) = 0 THEN arg_max(why, moment) END AS reason
           FROM judged GROUP BY owner_type, owner_id, product_id, size, color""",
        f"""owned AS (
    SELECT 'customer' AS owner_type, CAST(customer_id AS VARCHAR) AS owner_id, * FROM cart_items WHERE customer_id IS NOT NULL
    UNION ALL SELECT 'session', session_id, * FROM cart_items WHERE session_id IS NOT NULL),
  line AS (
    SELECT owner_type, owner_id, product_id, size, color, MIN(id) AS line_id, arg_min(quantity, id) AS old
    FROM owned GROUP BY owner_type, owner_id, product_id, size, color),
  holds AS (SELECT owner_type, owner_id, COUNT(DISTINCT product_id) AS n FROM owned GROUP BY owner_type, owner_id),
  asked AS ({batch}),
  seen AS (
    SELECT a.*, g.stock, g.is_active AS active, line.line_id, line.old,
           NOT COALESCE({invalid}, TRUE) AND COALESCE(g.is_active, FALSE)
             AND CASE WHEN line.line_id IS NOT NULL THEN g.stock >= 1 ELSE LEAST(q, g.stock) BETWEEN 1 AND 15 END AS fits
    FROM asked a LEFT JOIN products g ON g.product_id = a.product_id
    LEFT JOIN line ON line.owner_type = a.owner_type AND line.owner_id = a.owner_id AND line.product_id = a.product_id
                  AND line.size = a.size AND line.color = a.color),
  newest AS (
    SELECT owner_type, owner_id, product_id, MIN(moment) AS birth FROM seen s
    WHERE fits AND line_id IS NULL AND NOT EXISTS (
      SELECT 1 FROM owned o WHERE o.owner_type = s.owner_type AND o.owner_id = s.owner_id AND o.product_id = s.product_id)
    GROUP BY owner_type, owner_id, product_id),
  placed AS (
    SELECT r.*, {full} AS over,
           BOOL_OR(fits) OVER (PARTITION BY r.owner_type, r.owner_id, r.product_id, r.size, r.color ORDER BY moment) AS born
    FROM seen r LEFT JOIN holds h ON h.owner_type = r.owner_type AND h.owner_id = r.owner_id),
  judged AS (
    SELECT *, COALESCE(NOT ({invalid}), FALSE) AND COALESCE(active, FALSE) AND NOT over
              AND CASE WHEN line_id IS NOT NULL THEN stock >= 1 ELSE born END AS counted,
           CASE WHEN {bool(top)} AND COALESCE({invalid}, TRUE) THEN 'invalid quantity' WHEN over THEN 'cart holds the most products'
                WHEN active IS NULL THEN 'unknown product' WHEN NOT active THEN 'inactive product'
                WHEN COALESCE({invalid}, TRUE) THEN 'invalid quantity' ELSE 'quantity out of range' END AS why
    FROM placed)""",
    )


_ASKED = "CAST(CASE id % 20 WHEN 3 THEN NULL WHEN 7 THEN -1 WHEN 11 THEN 20 ELSE quantity END AS INTEGER) AS q, id AS moment"
register(
    "cart_merge",
    _cart_job(
        f"SELECT 'customer' AS owner_type, substr(session_id, 2) AS owner_id, CAST(product_id AS BIGINT) AS product_id, size, color, {_ASKED} FROM cart_items WHERE session_id IS NOT NULL",
        None,
    ),
)
register(
    "cart_add",
    _cart_job(
        f"""SELECT CASE WHEN customer_id IS NULL THEN 'session' ELSE 'customer' END AS owner_type,
                   COALESCE(CAST(customer_id AS VARCHAR), session_id) AS owner_id, product_id + id % 3 AS product_id, size, color, {_ASKED}
            FROM cart_items""",
        20,
    ),
)

register(
    "cart_set_quantity",
    q(
        """SELECT id, owner_type, owner_id, requested,
                  CASE WHEN NOT invalid THEN old_quantity END AS old_quantity,
                  CASE WHEN reason IS NULL THEN final END AS new_quantity,
                  CASE WHEN reason IS NULL THEN 'update' ELSE 'reject' END AS action, reason
           FROM (
             SELECT *, CASE WHEN invalid THEN 'invalid quantity'
                            WHEN active IS NULL THEN 'item not found'
                            WHEN NOT active THEN 'inactive product'
                            WHEN final < 1 THEN 'quantity out of range' END AS reason
             FROM (
               SELECT r.id, r.owner_type, r.owner_id, CAST(r.requested AS INTEGER) AS requested,
                      r.requested IS NULL OR r.requested < 1 OR r.requested > 15 AS invalid,
                      l.old_quantity, l.active, CAST(least(r.requested, l.stock, 15) AS INTEGER) AS final
               FROM req r LEFT JOIN (
                 SELECT lo.id, lo.owner_type, lo.owner_id, ci.quantity AS old_quantity, p.stock, p.is_active AS active
                 FROM line_owners lo JOIN cart_items ci ON ci.id = lo.id
                 JOIN products p ON p.product_id = ci.product_id) l
               ON l.id = r.id AND l.owner_type = r.owner_type AND l.owner_id = r.owner_id) x) y""",
        _LINE_OWNERS
        + """,
        req AS (
          SELECT id, 'customer' AS owner_type,
                 COALESCE(CAST(customer_id AS VARCHAR), substr(session_id, 2)) AS owner_id,
                 quantity + 3 AS requested
          FROM cart_items)""",
    ),
)

register(
    "cart_remove",
    q(
        """SELECT r.id, r.owner_type, r.owner_id, h.id IS NOT NULL AS removed,
                  CASE WHEN h.id IS NOT NULL THEN 'remove' ELSE 'reject' END AS action,
                  CASE WHEN h.id IS NULL THEN 'item not found' END AS reason
           FROM req r LEFT JOIN (SELECT DISTINCT id, owner_type, owner_id FROM line_owners) h
             ON h.id = r.id AND h.owner_type = r.owner_type AND h.owner_id = r.owner_id""",
        _LINE_OWNERS
        + f""",
        req AS (
          SELECT id, {_OWNER} FROM cart_items
          WHERE product_id IN (SELECT product_id FROM products WHERE NOT is_active)
          UNION ALL
          SELECT id, 'customer', substr(session_id, 2) FROM cart_items WHERE session_id IS NOT NULL)""",
    ),
)

register(
    "retention_cleanup",
    q(
        """SELECT *, COALESCE(customer_id IS NULL AND updated_at < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL '30 days', false)
                  AS expired
           FROM cart_items"""
    ),
)

register(
    "retention_counts",
    q(
        """SELECT CASE WHEN customer_id IS NULL AND updated_at < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL '30 days'
                       THEN 'expired' ELSE 'kept' END AS class, CAST(COUNT(*) AS BIGINT) AS lines
           FROM cart_items GROUP BY 1"""
    ),
)

register(
    "cart_product_popularity",
    q(
        f"""SELECT product_id, CAST(COUNT(DISTINCT owner_type || ':' || owner_id) AS BIGINT) AS carts,
                   CAST(SUM(quantity) AS BIGINT) AS units
            FROM (SELECT product_id, quantity, {_OWNER} FROM cart_items) t GROUP BY product_id"""
    ),
)
