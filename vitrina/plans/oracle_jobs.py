"""Oracle SQL for pricing, quality audits and ingest jobs."""

from __future__ import annotations

from ..sources import literals
from . import oracle_reports  # noqa: F401  (export statements reuse report statements)
from .oracle_sql import ORACLE, m, q, register

SQL_NAME = {"orders": "shop_orders"}


def sql_table(name: str) -> str:
    return SQL_NAME.get(name, name)


register(
    "price_orders",
    q(
        f"""SELECT order_id, currency_code, {m('subtotal')} AS subtotal, {m('disc')} AS discount_applied,
                   {m('subtotal - disc')} AS total
            FROM (
              SELECT o.order_id, o.currency_code, COALESCE(s.subtotal, 0) AS subtotal,
                     CASE WHEN p.discount_type IS NULL THEN 0
                          WHEN p.discount_type = 'percentage' THEN COALESCE(s.subtotal, 0) * p.discount_value * 0.01
                          WHEN o.currency_code = 'USD' THEN p.discount_value * 0.128
                          ELSE p.discount_value END AS disc
              FROM shop_orders o
              LEFT JOIN (SELECT order_id, SUM(quantity * unit_price) AS subtotal FROM order_items GROUP BY order_id) s
                ON s.order_id = o.order_id
              LEFT JOIN promotions p ON p.promo_id = o.promo_id) t"""
    ),
)

register(
    "convert_currency",
    q(
        f"""SELECT order_id, currency_code, {m('total')} AS total,
                   {m("CASE WHEN currency_code = 'GTQ' THEN total * 0.128 ELSE total END")} AS amount_usd
            FROM shop_orders"""
    ),
)

# (table, rule, SQL predicate) -- a row violates when the predicate is FALSE
CHECKS = [
    ("categories", "category_name not null", "category_name IS NOT NULL"),
    ("products", "product_name not null", "product_name IS NOT NULL"),
    ("products", "category_id not null", "category_id IS NOT NULL"),
    ("products", "price not null", "price IS NOT NULL"),
    ("products", "stock not null", "stock IS NOT NULL"),
    ("products", "price >= 0", "price >= 0"),
    ("products", "wholesale_price >= 0", "wholesale_price >= 0"),
    ("products", "stock >= 0", "stock >= 0"),
    ("product_variants", "stock >= 0", "stock >= 0"),
    ("product_variants", "stock not null", "stock IS NOT NULL"),
    ("product_reviews", "rating not null", "rating IS NOT NULL"),
    ("product_reviews", "rating between 1 and 5", "rating BETWEEN 1 AND 5"),
    ("customers", "email not null", "email IS NOT NULL"),
    ("customers", "first_name not null", "first_name IS NOT NULL"),
    ("customers", "last_name not null", "last_name IS NOT NULL"),
    ("orders", "total not null", "total IS NOT NULL"),
    ("orders", "total >= 0", "total >= 0"),
    ("orders", "status in domain", "status IN ('Pendiente','Procesando','Enviado','Entregado','Cancelado')"),
    ("orders", "shipping_status in domain", "shipping_status IN ('Preparando','En tránsito','Entregado','Fallido')"),
    ("orders", "currency_code length 3", "length(currency_code) = 3"),
    ("order_items", "quantity not null", "quantity IS NOT NULL"),
    ("order_items", "quantity > 0", "quantity > 0"),
    ("order_items", "unit_price >= 0", "unit_price >= 0"),
    ("payments", "amount not null", "amount IS NOT NULL"),
    ("payments", "amount > 0", "amount > 0"),
    ("payments", "status in domain", "status IN ('Pendiente','Aprobado','Rechazado','Reembolsado')"),
    ("cart_items", "quantity not null", "quantity IS NOT NULL"),
    ("cart_items", "quantity between 1 and 15", "quantity > 0 AND quantity <= 15"),
    ("cart_items", "session or customer present", "session_id IS NOT NULL OR customer_id IS NOT NULL"),
    ("promotions", "discount_type in domain", "discount_type IN ('percentage','fixed')"),
    ("promotions", "discount_value > 0", "discount_value > 0"),
]

register(
    "constraint_audit",
    q(
        "\nUNION ALL\n".join(
            f"SELECT '{t}' AS table_name, '{r}' AS rule, "
            f"CAST(COUNT(CASE WHEN NOT ({p}) THEN 1 END) AS BIGINT) AS violations FROM {sql_table(t)}"
            for t, r, p in CHECKS
        )
    ),
)

FKS = [
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

register(
    "referential_audit",
    q(
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS table_name, '{cc} -> {p}.{pc}' AS rule, CAST(COUNT(*) AS BIGINT) AS violations "
            f"FROM {sql_table(c)} x WHERE x.{cc} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {sql_table(p)} y WHERE CAST(y.{pc} AS BIGINT) = CAST(x.{cc} AS BIGINT))"
            for c, cc, p, pc in FKS
        )
    ),
)

UNIQUES = [
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

register(
    "uniqueness_audit",
    q(
        "\nUNION ALL\n".join(
            f"SELECT '{t}' AS table_name, 'unique({', '.join(cols)})' AS rule, CAST(COUNT(*) AS BIGINT) AS violations "
            f"FROM (SELECT {', '.join(cols)} FROM {sql_table(t)} WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)} "
            f"GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1) d"
            for t, cols in UNIQUES
        )
    ),
)

TABLES = [
    "categories", "products", "product_variants", "countries", "cities", "customers", "customer_addresses",
    "orders", "order_items", "payments", "product_reviews", "cart_items", "promotions", "shipping_zones",
]

register(
    "table_row_counts",
    q(
        "\nUNION ALL\n".join(
            f"SELECT '{t}' AS tabla, CAST(COUNT(*) AS BIGINT) AS registros FROM {sql_table(t)}" for t in TABLES
        )
    ),
)

_FORMS = """forms AS (
    SELECT product_id AS form_id, product_name, '  ' || description || ' ' AS description,
           CAST(price AS VARCHAR) AS price, CAST(stock - 5 AS VARCHAR) AS stock,
           CAST(category_id AS VARCHAR) AS category_id,
           CASE WHEN is_active THEN 'true' END AS is_active,
           CASE WHEN stock % 2 = 0 THEN image_url ELSE ' ' END AS image_url
    FROM products),
  parsed AS (
    SELECT *, TRY_CAST(trim(price) AS DECIMAL(10,2)) AS p, TRY_CAST(trim(category_id) AS INTEGER) AS c,
           COALESCE(TRY_CAST(trim(stock) AS INTEGER), 0) AS s
    FROM forms),
  cleaned AS (
    SELECT form_id, trim(product_name) AS product_name, COALESCE(trim(description), '') AS description,
           p, s AS stock, c AS category_id, COALESCE(is_active = 'true', false) AS is_active,
           CASE WHEN trim(image_url) <> '' THEN trim(image_url) END AS image_url,
           CASE WHEN product_name IS NULL OR product_name = '' OR price IS NULL OR price = ''
                     OR category_id IS NULL OR category_id = '' OR p = 0 OR c = 0
                THEN 'name, price and category are required'
                WHEN p IS NULL THEN 'invalid price'
                WHEN c IS NULL OR c NOT IN (SELECT category_id FROM categories) THEN 'invalid category'
                WHEN p < 0 OR s < 0 THEN 'negative price or stock' END AS reason
    FROM parsed)"""

register(
    "clean_products",
    q(
        f"""SELECT form_id, product_name, description, {m('p')} AS price, stock, category_id, is_active, image_url,
                   CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason
            FROM cleaned""",
        _FORMS,
    ),
)

_VALUES = "product_name, description, price, stock, category_id, is_active, image_url"
_NONE = "NULL, NULL, NULL, NULL, NULL, NULL, NULL"
register(
    "apply_product_changes",
    q(
        f"""SELECT product_id, last_op AS op, changes,
                   CASE WHEN last_op IS NULL THEN 'not found' WHEN last_op = 'delete' THEN 'deleted' WHEN existed THEN 'updated' ELSE 'created' END AS result,
                   state.product_name, state.description, {m('state.price')} AS price, state.stock, state.category_id,
                   CASE WHEN last_op = 'delete' THEN FALSE ELSE state.is_active END AS is_active, state.image_url
            FROM (
              SELECT e.product_id, CAST(COUNT(*) AS BIGINT) AS changes, BOOL_OR(existed) AS existed, arg_max(op, place) FILTER (works) AS last_op,
                     CASE WHEN COUNT(*) FILTER (works) = 0 THEN NULL
                          WHEN COUNT(*) FILTER (works AND op <> 'delete') > 0 THEN arg_max(own, place) FILTER (works AND op <> 'delete')
                          ELSE ANY_VALUE(old) END AS state
              FROM (
                SELECT c.product_id, c.op, g.product_id IS NOT NULL AS existed, c.place,
                       {{'product_name': c.product_name, 'description': c.description, 'price': c.price, 'stock': c.stock,
                         'category_id': c.category_id, 'is_active': c.is_active, 'image_url': c.image_url}} AS own,
                       {{'product_name': g.product_name, 'description': g.description, 'price': g.price, 'stock': g.stock,
                         'category_id': g.category_id, 'is_active': g.is_active, 'image_url': g.image_url}} AS old,
                       -- a change works if the product is there when it comes
                       CASE WHEN g.product_id IS NOT NULL THEN c.op <> 'insert'
                            ELSE COALESCE(BOOL_OR(c.op = 'insert') OVER (PARTITION BY c.product_id ORDER BY c.place), FALSE) END AS works
                FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY seq, op = 'delete', op = 'update') AS place FROM changes) c
                LEFT JOIN products g ON g.product_id = c.product_id) e
              GROUP BY e.product_id) r""",
        _FORMS
        + f""",
  posts AS (SELECT form_id, product_name, description, p AS price, stock, category_id, is_active, image_url FROM cleaned WHERE reason IS NULL),
  changes AS (
    SELECT form_id + 10000000 AS product_id, 'update' AS op, 1 AS seq, {_VALUES} FROM posts WHERE form_id % 22 = 0
    UNION ALL SELECT form_id, 'update', 2, {_VALUES} FROM posts
    UNION ALL SELECT form_id + 10000000, 'insert', 2, {_VALUES} FROM posts WHERE form_id % 11 = 0
    UNION ALL SELECT form_id + 10000000, 'update', 3, {_VALUES} FROM posts WHERE form_id % 33 = 0
    UNION ALL SELECT form_id + 20000000, 'update', 2, {_VALUES} FROM posts WHERE form_id % 50 = 0
    UNION ALL SELECT product_id, 'delete', 1, {_NONE} FROM products WHERE product_id NOT IN (SELECT product_id FROM order_items)
    UNION ALL SELECT product_id, 'delete', 4, {_NONE} FROM products WHERE product_id % 7 = 0)""",
    ),
)

register(
    "clean_customers",
    q(
        """SELECT request_id, first_name, last_name, email, NULLIF(phone, '') AS phone,
                  CASE WHEN why IS NULL AND NOT known AND turn = 1 THEN 'accepted' ELSE 'rejected' END AS status,
                  CASE WHEN why IS NOT NULL THEN why WHEN known THEN 'email already registered'
                       WHEN turn > 1 THEN 'email repeated in batch' END AS reason
           FROM (
             SELECT *, email IN (SELECT lower(email) FROM customers) AS known,
                    ROW_NUMBER() OVER (PARTITION BY email, why IS NULL ORDER BY arrival) AS turn
             FROM (
               SELECT *, CASE WHEN first_name = '' OR last_name = '' OR email = '' OR COALESCE(password, '') = '' THEN 'all fields are required'
                              WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'invalid email'
                              WHEN password IS DISTINCT FROM confirm THEN 'passwords do not match'
                              WHEN length(password) < 8 THEN 'password shorter than 8 characters' END AS why
               FROM (SELECT request_id, arrival, COALESCE(trim(first_name), '') AS first_name, COALESCE(trim(last_name), '') AS last_name,
                            lower(COALESCE(trim(email), '')) AS email, COALESCE(trim(phone), '') AS phone, password, confirm FROM regs) c) d) e""",
        """guests AS (
    SELECT order_id, guest_name, guest_email, 'secret-' || CAST(order_id AS VARCHAR) || '-word' AS good FROM shop_orders WHERE customer_id IS NULL),
  tries AS (
    SELECT *, CASE order_id % 9 WHEN 1 THEN NULL WHEN 2 THEN 'short' ELSE good END AS password FROM guests),
  regs AS (
    SELECT 'o' || CAST(order_id AS VARCHAR) AS request_id, order_id AS arrival, split_part(guest_name, ' ', 1) AS first_name,
           split_part(guest_name, ' ', 2) AS last_name, ' ' || guest_email AS email, CAST(NULL AS VARCHAR) AS phone, password,
           CASE order_id % 9 WHEN 4 THEN 'other' WHEN 5 THEN NULL ELSE password END AS confirm FROM tries
    UNION ALL
    SELECT 'p' || CAST(order_id AS VARCHAR), order_id + 1000000000000, 'Guest', CAST(order_id AS VARCHAR), upper(guest_email), '555', good, good
    FROM guests WHERE order_id % 3 = 0
    UNION ALL
    SELECT 'c' || CAST(customer_id AS VARCHAR), customer_id + 2000000000000, first_name, last_name, upper(email), phone, 'long enough', 'long enough'
    FROM customers)""",
    ),
)

register(
    "link_identities",
    # the logins of each group that shares ids or accounts, one after the other; ``held``: who has which id, ``born``: new accounts
    q(
        """SELECT provider, provider_id, email, arrival, action,
                  CASE WHEN who LIKE 'c:%' THEN CAST(substr(who, 3) AS BIGINT) END AS customer_id
           FROM replay WHERE turn > 0""",
        """own AS (SELECT *, COALESCE(google_id, 'new-g' || CAST(customer_id AS VARCHAR)) AS g FROM customers),
  guests AS (SELECT order_id, guest_email FROM shop_orders WHERE customer_id IS NULL),
  logins AS (
    SELECT customer_id AS arrival, 'google' AS provider, g AS provider_id, upper(email) AS email FROM own
    UNION ALL SELECT order_id + 1000000000000, 'facebook', 'fb-' || CAST(order_id AS VARCHAR), guest_email FROM guests
    UNION ALL SELECT order_id + 2000000000000, 'google', 'gb-' || CAST(order_id AS VARCHAR), guest_email FROM guests WHERE order_id % 5 = 0
    UNION ALL SELECT order_id + 3000000000000, 'facebook', 'fb-' || CAST(order_id AS VARCHAR), guest_email FROM guests WHERE order_id % 7 = 0
    UNION ALL SELECT customer_id + 4000000000000, 'google', 'other-g' || CAST(customer_id AS VARCHAR), upper(email) FROM own WHERE customer_id % 4 = 0
    UNION ALL SELECT customer_id + 5000000000000, 'google', g, upper(email) FROM own WHERE customer_id % 4 = 0
    UNION ALL SELECT customer_id + 6000000000000, 'google', 'other-g' || CAST(customer_id - 1 AS VARCHAR), upper(email) FROM own WHERE customer_id % 8 = 1
    UNION ALL SELECT customer_id + 7000000000000, 'google', g, NULL FROM own WHERE customer_id % 8 = 1
    UNION ALL SELECT customer_id + 8000000000000, 'google', 'other-g' || CAST(customer_id - 1 AS VARCHAR), NULL FROM own WHERE customer_id % 8 = 1
    UNION ALL SELECT customer_id + 9000000000000, 'google', 'other-g' || CAST(customer_id AS VARCHAR), upper(email) FROM own WHERE customer_id % 8 = 0
    UNION ALL SELECT order_id + 10000000000000, 'google', 'gx-' || CAST(order_id AS VARCHAR), NULL FROM guests WHERE order_id % 11 = 0),
  owners AS (SELECT lower(email) AS e, MIN(customer_id) AS id FROM customers GROUP BY ALL),
  stored AS (
    SELECT 'google|' || google_id AS k, 'c:' || CAST(MIN(customer_id) AS VARCHAR) AS account FROM customers WHERE google_id IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'facebook|' || facebook_id, 'c:' || CAST(MIN(customer_id) AS VARCHAR) FROM customers WHERE facebook_id IS NOT NULL GROUP BY ALL),
  named AS (
    SELECT l.*, l.provider || '|' || l.provider_id AS k, CASE WHEN l.email IS NOT NULL THEN COALESCE('c:' || CAST(o.id AS VARCHAR), 'e:' || lower(l.email)) END AS account
    FROM logins l LEFT JOIN owners o ON o.e = lower(l.email)),
  used AS (SELECT k, account FROM named UNION SELECT s.k, s.account FROM stored s WHERE k IN (SELECT k FROM named) OR account IN (SELECT account FROM named)),
  links AS (SELECT k AS a, COALESCE(account, k) AS b FROM used),
  nodes AS (SELECT a AS node, MIN(least(a, b)) AS label FROM (SELECT a, b FROM links UNION SELECT b, a FROM links) GROUP BY ALL),
  reach AS (
    SELECT a AS node, a AS other FROM (SELECT a FROM links UNION SELECT b FROM links) UNION
    SELECT r.node, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.other),
  parts AS (SELECT node, MIN(other) AS part FROM reach GROUP BY ALL),
  turns AS (SELECT n.*, p.part, ROW_NUMBER() OVER (PARTITION BY p.part ORDER BY n.arrival) AS turn FROM named n JOIN parts p ON p.node = n.k),
  replay AS (
    SELECT t.part, CAST(0 AS BIGINT) AS turn, COALESCE(list({'k': s.k, 'a': s.account}) FILTER (WHERE s.k IS NOT NULL), []) AS held, CAST([] AS VARCHAR[]) AS born,
           CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS provider_id, CAST(NULL AS VARCHAR) AS email,
           CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS who
    FROM (SELECT DISTINCT part FROM turns) t LEFT JOIN (SELECT s.*, p.part FROM stored s JOIN parts p ON p.node = s.k) s USING (part) GROUP BY t.part
    UNION ALL
    SELECT part, turn,
           CASE WHEN holder IS NULL AND account IS NOT NULL
                THEN list_append(list_filter(held, lambda h: NOT (h.a = account AND split_part(h.k, '|', 1) = provider)), {'k': k, 'a': account}) ELSE held END,
           CASE WHEN holder IS NULL AND account LIKE 'e:%' THEN list_append(born, account) ELSE born END,
           arrival, provider, provider_id, email,
           CASE WHEN holder IS NOT NULL THEN 'login' WHEN account IS NULL THEN 'reject'
                WHEN account LIKE 'c:%' OR list_contains(born, account) THEN 'link' ELSE 'create' END,
           COALESCE(holder, account)
    FROM (SELECT t.*, r.held, r.born, list_filter(r.held, lambda h: h.k = t.k)[1].a AS holder FROM replay r JOIN turns t ON t.part = r.part AND t.turn = r.turn + 1) x)""",
    ).replace("WITH categories", "WITH RECURSIVE categories", 1),
)

register(
    "slugify",
    q(
        """SELECT 'product' AS kind, CAST(product_id AS BIGINT) AS id, product_name AS name,
                  regexp_replace(regexp_replace(translate(lower(product_name), 'áàäâéèëêíìïîóòöôúùüû',
                                                          'aaaaeeeeiiiioooouuuu'),
                                                '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
                  || '-' || CAST(product_id AS VARCHAR) AS slug
           FROM products
           UNION ALL
           SELECT 'category', CAST(category_id AS BIGINT), category_name, replace(lower(category_name), ' ', '-')
           FROM categories"""
    ),
)

register(
    "slug_consistency",
    q(
        """SELECT category_id, category_name, slug FROM categories
           WHERE slug IS NULL OR slug NOT IN (""" + ", ".join(f"'{slug}'" for slug in literals.CATEGORY_SLUGS) + ")"
    ),
)

register(
    "kpi_long",
    q(
        """SELECT unnest(['total customers', 'total products', 'total orders', 'total revenue', 'avg ticket', 'pending orders']) AS metrica,
                  unnest([CAST(customers AS DOUBLE), CAST(products AS DOUBLE), CAST(orders AS DOUBLE),
                          CAST(ROUND(amount, 2) AS DOUBLE), ticket, CAST(waiting AS DOUBLE)]) AS valor FROM figures""",
        oracle_reports.FIGURES,
    ),
)


def _abbrev_sql(x: str, ladder: list[tuple[int, str]]) -> str:
    parts = []
    for threshold, suffix in ladder:
        scale = "0." + "0" * (len(str(threshold)) - 2) + "1"
        parts.append(
            f"WHEN {x} >= {threshold} THEN regexp_replace(CAST(CAST(ROUND({x} * {scale}, 1) AS DECIMAL(38,1)) AS VARCHAR), '\\.0$', '') || '{suffix}'"
        )
    return f"CASE {' '.join(parts)} ELSE CAST(CAST(ROUND({x}, 2) AS DECIMAL(38,2)) AS VARCHAR) END"


register(
    "abbreviate_amount",
    q(
        f"""SELECT month, {m('rev')} AS revenue,
                   {_abbrev_sql('rev', [(10**12, 'T'), (10**9, 'B'), (10**6, 'M'), (10**3, 'K')])} AS formatted,
                   {_abbrev_sql('rev', [(10**6, 'M'), (10**3, 'K')])} AS formatted_short
            FROM (SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, SUM(total) AS rev
                  FROM shop_orders WHERE status != 'Cancelado' GROUP BY 1) t"""
    ),
)

register(
    "chart_series_monthly",
    q(
        f"""SELECT month, COALESCE(revenue, 0.0) AS revenue FROM (
              SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, {m('SUM(total)')} AS revenue
              FROM shop_orders WHERE status != 'Cancelado' GROUP BY 1 ORDER BY month DESC LIMIT 12) t"""
    ),
)


def _csv_field(expr: str, kind: str) -> str:
    """One quoted CSV field: text of the value ('' for NULL), quotes doubled."""
    text = f"CAST(CAST({expr} AS DECIMAL(38,2)) AS VARCHAR)" if kind == "double" else f"CAST({expr} AS VARCHAR)"
    return f"'\"' || replace(COALESCE({text}, ''), '\"', '\"\"') || '\"'"


def _csv_line(fields: list[tuple[str, str]]) -> str:
    return " || ',' || ".join(_csv_field(e, k) for e, k in fields)


def _body(key: str) -> str:
    return ORACLE[key]


register(
    "export_csv",
    "SELECT "
    + _csv_line(
        [("category_id", "int"), ("category_name", "str"), ("total_orders", "int"), ("units_sold", "int"), ("revenue", "double")]
    )
    + " AS line FROM (\n"
    + _body("sales_by_category")
    + "\n) r",
)

register(
    "export_csv_full",
    q(
        """SELECT '"' || unnest(['total customers', 'total products', 'total orders', 'total revenue', 'avg ticket', 'pending orders']) || '","'
                  || unnest([CAST(customers AS VARCHAR), CAST(products AS VARCHAR), CAST(orders AS VARCHAR),
                             CAST(CAST(ROUND(amount, 2) AS DECIMAL(38,2)) AS VARCHAR), CAST(CAST(ticket AS DECIMAL(38,2)) AS VARCHAR),
                             CAST(waiting AS VARCHAR)]) || '"' AS line FROM figures""",
        oracle_reports.FIGURES,
    ),
)

_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
register(
    "export_json",
    f"""SELECT CAST(to_json({{'customer_id': customer_id, 'email': email, 'full_name': full_name, 'total_orders': total_orders,
                            'lifetime_value': CAST(lifetime_value AS DECIMAL(38,2)),
                            'avg_order_value': CAST(avg_order_value AS DECIMAL(38,2)),
                            'last_order_date': strftime(last_order_date, {_STAMP})}}) AS VARCHAR) AS value FROM (
"""
    + q(
        f"""SELECT {oracle_reports.VALUE_OUT} FROM (
              SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC NULLS LAST, customer_id) AS place FROM customer_values) v WHERE place <= 20""",
        oracle_reports.VALUES,
    )
    + "\n) p",
)

register(
    "export_json_pending",
    f"""SELECT CAST(to_json({{'order_id': order_id, 'order_date': strftime(order_date, {_STAMP}), 'customer_name': customer_name, 'email': email,
                            'total': CAST(total AS DECIMAL(38,2)), 'currency_code': currency_code, 'status': status,
                            'shipping_status': shipping_status, 'city_name': city_name, 'country_name': country_name,
                            'is_guest': is_guest}}) AS VARCHAR) AS value FROM (
"""
    + q(oracle_reports.PENDING, oracle_reports.PLACES)
    + "\n) p",
)


def _json_of(key: str, fields: str) -> str:
    return f"SELECT CAST(to_json({{{fields}}}) AS VARCHAR) AS value FROM (\n{_body(key)}\n) p"


register(
    "export_json_categories",
    _json_of(
        "sales_by_category",
        "'category_id': category_id, 'category_name': category_name, 'total_orders': total_orders, 'units_sold': units_sold, 'revenue': CAST(revenue AS DECIMAL(38,2))",
    ),
)
register(
    "export_json_top_products",
    _json_of(
        "top_products",
        """'product_id': product_id, 'product_name': product_name, 'category_name': category_name, 'units_sold': units_sold,
           'revenue': CAST(revenue AS DECIMAL(38,2)), 'current_stock': current_stock""",
    ),
)
register(
    "export_json_monthly",
    _json_of(
        "monthly_revenue",
        f"""'month': strftime(month, {_STAMP}), 'total_orders': total_orders, 'revenue': CAST(revenue AS DECIMAL(38,2)),
            'avg_order_value': CAST(avg_order_value AS DECIMAL(38,2)), 'unique_customers': unique_customers""",
    ),
)
register(
    "export_json_low_stock",
    _json_of(
        "low_stock_products",
        """'product_id': product_id, 'product_name': product_name, 'category_name': category_name, 'stock': stock,
           'price': CAST(price AS DECIMAL(38,2)), 'sold_last_30_days': sold_last_30_days""",
    ),
)
