"""DuckDB oracle SQL per query key.

Each statement starts with the table mapping as CTEs (the same mapping that
``vitrina.sources.tables`` builds with DataFrame expressions) and then states
the report the way the shop's SQL states it. Money leaves as DOUBLE rounded
to cents, counts as BIGINT, averages of money by integer cents.
"""

from __future__ import annotations

MAPPING = {
    "categories": """
        SELECT DISTINCT CAST(substr(p_brand,7) AS INT) category_id, p_brand category_name,
               lower(replace(p_brand,'#','-')) slug FROM part
        UNION ALL SELECT 99, 'Brand#99', 'brand-99'""",
    "products": """
        SELECT p_partkey product_id,
               CASE WHEN p_partkey % 37 = 0 THEN 'Ánfora ' WHEN p_partkey % 41 = 0 THEN 'zócalo ' ELSE '' END || p_name product_name, concat(p_name,' ',lower(p_type)) description,
               CAST(substr(p_brand,7) AS INT) category_id, CAST(p_retailprice AS DECIMAL(10,2)) price,
               CAST(p_retailprice*0.8 AS DECIMAL(10,2)) wholesale_price, p_size-1 stock,
               p_partkey % 20 <> 0 is_active, CAST(DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) AS TIMESTAMP) created_at,
               '/img/p' || CAST(p_partkey AS VARCHAR) || '.jpg' image_url
        FROM part""",
    "product_variants": """
        SELECT p_partkey*10+i variant_id, p_partkey product_id,
               p_name || ' / ' || CAST(i AS VARCHAR) variant_name,
               'SKU-' || CAST(p_partkey*10+i AS VARCHAR) sku,
               CASE i WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'L' ELSE '' END size,
               CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN i<3 THEN 'Rojo' ELSE 'Azul' END color,
               CASE i WHEN 1 THEN 'Jade' WHEN 2 THEN 'Plata' WHEN 3 THEN '' END material,
               CAST(i*5 AS DECIMAL(10,2)) additional_price,
               (p_size*i) % 12 stock, (p_partkey+i) % 5 <> 0 AND p_partkey % 9 <> 0 is_active
        FROM part CROSS JOIN (VALUES (1),(2),(3),(4)) v(i) WHERE p_partkey % 3 = 0""",
    "countries": """
        SELECT r_regionkey country_id, substr(r_name,1,3) country_code, r_name country_name FROM region""",
    "cities": """
        SELECT n_nationkey city_id, n_name city_name, n_regionkey country_id FROM nation""",
    "customers": """
        SELECT c_custkey customer_id, concat(lower(c_name),'@example.org') email,
               split_part(c_name,'#',1) first_name,
               CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE split_part(c_name,'#',2) END last_name,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '+502 ' || CAST(c_custkey AS VARCHAR) END phone,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END city_id,
               CAST(DATE '2023-01-01' + CAST(c_custkey % 365 AS INT) AS TIMESTAMP) created_at,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    ELSE CAST(DATE '2023-01-01' + CAST(c_custkey % 365 + 30 AS INT) AS TIMESTAMP) END last_login,
               CASE WHEN c_custkey % 5 = 0 THEN 'g' || CAST(c_custkey AS VARCHAR) END google_id,
               CASE WHEN c_custkey % 13 = 0 THEN 'f' || CAST(c_custkey AS VARCHAR) END facebook_id
        FROM customer""",
    "customer_addresses": """
        SELECT c_custkey address_id, c_custkey customer_id, c_nationkey city_id FROM customer""",
    "shop_orders": """
        SELECT o_orderkey order_id,
               CASE WHEN o_orderkey % 10 = 0 OR o_custkey % 50 = 0 THEN NULL ELSE o_custkey END customer_id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END shipping_address_id,
               o_orderdate order_date,
               CASE WHEN o_custkey % 211 = 5 THEN 'Cancelado' WHEN o_orderpriority='1-URGENT' THEN 'Pendiente'
                    WHEN o_orderpriority='2-HIGH' THEN 'Procesando' WHEN o_orderpriority='3-MEDIUM' THEN 'Enviado'
                    WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'Entregado' ELSE 'Cancelado' END status,
               CASE o_orderpriority WHEN '3-MEDIUM' THEN 'En tránsito' WHEN '4-NOT SPECIFIED' THEN 'Entregado'
                    ELSE 'Preparando' END shipping_status,
               CAST(o_totalprice AS DECIMAL(10,2)) total,
               CASE WHEN o_orderstatus='P' THEN 'USD' ELSE 'GTQ' END currency_code,
               CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 4 END promo_id,
               concat('guest',CAST(o_orderkey AS VARCHAR(20)),'@example.org') guest_email,
               CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE concat('Guest ',CAST(o_orderkey AS VARCHAR(20))) END guest_name
        FROM orders""",
    "order_items": """
        SELECT l_orderkey order_id, l_linenumber line_no, 
               l_partkey + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END product_id, CAST(l_quantity AS INT) quantity,
               CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(10,2)) unit_price
        FROM lineitem""",
    "payments": """
        SELECT l_orderkey order_id, CAST(l_extendedprice AS DECIMAL(10,2)) amount,
               CASE l_returnflag WHEN 'A' THEN 'Aprobado' WHEN 'N' THEN 'Pendiente' ELSE 'Reembolsado' END status
        FROM lineitem""",
    "product_reviews": """
        SELECT event_id review_id, event_id % 200 product_id,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END customer_id,
               CAST(1 + event_id % 5 AS INT) rating, event_type || ' ' || props review_text,
               event_id % 2 = 0 is_verified_purchase, event_type <> 'error' is_approved, ts created_at
        FROM events""",
    "cart_items": """
        SELECT event_id id, CASE WHEN user_id % 4 = 0 THEN concat('s',CAST(user_id AS VARCHAR(20))) END session_id,
               CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END customer_id,
               CAST(substr(props,7,length(props)-7) AS INT) + CASE WHEN event_id % 50 = 7 THEN 9000000 ELSE 0 END product_id, CAST(1 + event_id % 15 AS INT) quantity,
               CASE WHEN event_id % 3 = 0 THEN '' ELSE 'M' END size, '' color, ts updated_at
        FROM events""",
    "promotions": """
        SELECT * FROM (VALUES (1,'PROMO-A','percentage',CAST(15 AS DECIMAL(10,2))),
                              (2,'PROMO-B','percentage',CAST(10 AS DECIMAL(10,2))),
                              (3,'PROMO-C','fixed',CAST(50 AS DECIMAL(10,2))),
                              (4,'PROMO-D','percentage',CAST(20 AS DECIMAL(10,2))))
               p(promo_id,promo_code,discount_type,discount_value)""",
    "shipping_zones": """
        SELECT * FROM (VALUES (1,'Zona A',['AFR']),(2,'Zona B',['AME','ASI','AME']),
                              (3,'Zona C',['EUR','MID']),(4,'Zona D',['ZZZ']))
               z(zone_id,zone_name,countries)""",
}

WITH_MAPPING = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in MAPPING.items())


def q(body: str, ctes: str = "") -> str:
    """Full statement: mapping CTEs, optional extra CTEs (``name AS (...)``), body."""
    extra = f",\n{ctes}" if ctes.strip() else ""
    return f"{WITH_MAPPING}{extra}\n{body}"


# Helpers for money columns in DuckDB.
def m(expr: str) -> str:
    return f"CAST(ROUND({expr}, 2) AS DOUBLE)"


def avg2(col: str) -> str:
    """Half-up rounded average of a money column via integer cents."""
    cents = f"CAST(SUM({col})*100 AS HUGEINT)"
    n = f"COUNT({col})"
    return f"CASE WHEN {n} > 0 THEN CAST((2*{cents} + {n}) // (2*{n}) AS DOUBLE) / 100.0 END"


ORACLE: dict[str, str] = {}


def register(key: str, sql: str) -> None:
    ORACLE[key] = sql
