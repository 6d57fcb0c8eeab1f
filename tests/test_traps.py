"""Micro-fixtures for the semantic traps the mapped data cannot reach."""

from __future__ import annotations

import datetime as dt

import pytest

from tests.fixtures import D, make_tables, ts
from vitrina.operators import carts, catalog, customers, export, ingest, pricing, reports

CATS = [
    {"category_id": 1, "category_name": "X", "slug": "x"},
    {"category_id": 2, "category_name": "Y", "slug": "y"},
    {"category_id": 3, "category_name": "Z", "slug": "z"},
    {"category_id": 4, "category_name": "W", "slug": "w"},
]


def product(pid, cat, price="10.00", stock=5, active=True, name=None, description=None):
    return {
        "product_id": pid, "product_name": name or f"p{pid}", "description": description, "category_id": cat,
        "price": D(price), "wholesale_price": D(price), "stock": stock, "is_active": active,
        "created_at": dt.datetime(2024, 1, pid % 28 + 1), "image_url": None,
    }


def order(oid, status="Entregado", total="100.00", cid=1, date="2024-01-10 10:00:00", currency="GTQ", promo=None, **kw):
    row = {
        "order_id": oid, "customer_id": cid, "shipping_address_id": cid, "order_date": ts(date), "status": status,
        "shipping_status": "Entregado", "total": D(total), "currency_code": currency, "promo_id": promo,
        "guest_email": f"g{oid}@x.org", "guest_name": f"Guest {oid}",
    }
    row.update(kw)
    return row


def item(oid, pid, qty=1, price="10.00"):
    return {"order_id": oid, "line_no": 1, "product_id": pid, "quantity": qty, "unit_price": D(price)}


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


# Outer join then WHERE on the right side; NULL ordering
def test_s1_only_cancelled_vanish_never_sold_stay(spark):
    t = make_tables(
        spark,
        categories=CATS,
        products=[product(10, 1), product(20, 2), product(40, 4)],
        orders=[order(1, "Cancelado"), order(2, "Entregado")],
        order_items=[item(1, 10, 2), item(2, 40, 3, "5.00")],
    )
    out = rows_by(reports.sales_by_category(t), "category_name")
    assert "X" not in out  # sold only in a cancelled order
    assert out["Y"]["total_orders"] == 0 and out["Y"]["revenue"] is None  # product, no items
    assert out["Z"]["total_orders"] == 0 and out["Z"]["units_sold"] is None  # no product
    assert out["W"] == {"category_id": 4, "category_name": "W", "total_orders": 1, "units_sold": 3, "revenue": 15.0}
    order_ = [r.category_name for r in reports.sales_by_category(t).collect()]
    assert order_[0] == "W"  # NULL revenue sorts last (view order)
    top = rows_by(reports.top_products(t), "product_id")
    assert 10 not in top and top[20]["units_sold"] is None and top[40]["units_sold"] == 3


def test_s1_customer_with_only_cancelled_orders_disappears(spark):
    t = make_tables(
        spark,
        customers=[
            {"customer_id": 1, "email": "a@x.org", "first_name": "A", "last_name": "B"},
            {"customer_id": 2, "email": "c@x.org", "first_name": "C", "last_name": None},
            {"customer_id": 3, "email": "d@x.org", "first_name": "D", "last_name": "E"},
        ],
        orders=[order(1, "Cancelado", cid=1), order(2, "Entregado", "10.00", cid=3), order(3, "Pendiente", "20.01", cid=3)],
    )
    out = rows_by(reports.customer_lifetime_value(t), "customer_id")
    assert set(out) == {2, 3}
    assert out[2]["total_orders"] == 0 and out[2]["full_name"] is None  # S4
    assert out[3]["lifetime_value"] == 30.01 and out[3]["avg_order_value"] == 15.01  # 15.005 half-up


# NULL in || and the pending-orders name chain
def test_s4_pending_orders_names(spark):
    t = make_tables(
        spark,
        customers=[{"customer_id": 1, "email": "a@x.org", "first_name": "Ana", "last_name": None}],
        orders=[
            order(1, "Pendiente", cid=1),
            order(2, "Pendiente", cid=None, guest_name="Luis"),
            order(3, "Procesando", cid=None, guest_name=None),
            order(4, "Entregado", cid=None),
        ],
    )
    out = rows_by(reports.pending_orders(t), "order_id")
    assert set(out) == {1, 2, 3}
    assert out[1]["customer_name"] == "Guest 1" and out[1]["email"] == "a@x.org" and not out[1]["is_guest"]
    assert out[2]["customer_name"] == "Luis" and out[2]["is_guest"]
    assert out[3]["customer_name"] == "Invitado"


# The "last 30 days" column as written vs as intended
def test_s6_recent_vs_old(spark):
    t = make_tables(
        spark,
        categories=CATS,
        products=[product(1, 1, stock=3)],
        orders=[
            order(1, date="2001-01-01 00:00:00"),
            order(2, date="2001-07-20 00:00:00"),
            order(3, "Cancelado", date="2001-07-25 00:00:00"),
        ],
        order_items=[item(1, 1, 1), item(2, 1, 2), item(3, 1, 4)],
    )
    assert reports.low_stock_products(t).collect()[0]["sold_last_30_days"] == 7
    assert reports.low_stock_recent_sales(t, as_of="2001-08-01 00:00:00").collect()[0]["sold_last_30_days"] == 2


# Month edges and exact half-up averages
def test_s7_s8_month_edges_and_avg_ties(spark):
    t = make_tables(
        spark,
        orders=[
            order(1, total="0.01", date="2024-03-01 00:00:00"),
            order(2, total="0.00", date="2024-03-31 23:59:59"),
            order(3, total="1.00", date="2024-04-01 00:00:00"),
        ],
    )
    out = rows_by(reports.monthly_revenue(t), "month")
    march = out[dt.datetime(2024, 3, 1)]
    assert march["total_orders"] == 2 and march["avg_order_value"] == 0.01  # 0.005 rounds up
    assert out[dt.datetime(2024, 4, 1)]["total_orders"] == 1


# Zone shapes
def test_s10_zone_shapes(spark):
    t = make_tables(
        spark,
        countries=[{"country_id": 1, "country_code": "AAA", "country_name": "A"}, {"country_id": 2, "country_code": "BBB", "country_name": "B"}],
        cities=[{"city_id": 1, "city_name": "c1", "country_id": 1}, {"city_id": 2, "city_name": "c2", "country_id": 2}],
        customer_addresses=[{"address_id": 1, "customer_id": 1, "city_id": 1}, {"address_id": 2, "customer_id": 2, "city_id": 2}],
        orders=[order(1, total="10.00", cid=1), order(2, total="5.00", cid=2)],
        shipping_zones=[
            {"zone_id": 1, "zone_name": "dup", "countries": ["AAA", "AAA"]},
            {"zone_id": 2, "zone_name": "both", "countries": ["AAA", "BBB"]},
            {"zone_id": 3, "zone_name": "null", "countries": None},
            {"zone_id": 4, "zone_name": "empty", "countries": []},
        ],
    )
    out = rows_by(reports.shipping_zone_revenue(t), "zone_name")
    assert out["dup"]["total_orders"] == 1 and out["dup"]["revenue"] == 10.0  # no duplication
    assert out["both"]["total_orders"] == 2 and out["both"]["revenue"] == 15.0
    assert out["null"]["total_orders"] == 0 and out["null"]["revenue"] is None
    assert out["empty"]["total_orders"] == 0


# Two stock notions
def test_s11_variant_stock(spark):
    t = make_tables(
        spark,
        products=[product(1, 1, stock=7), product(2, 1, stock=7), product(3, 1, stock=7), product(4, 1, stock=7)],
        product_variants=[
            {"variant_id": 21, "product_id": 2, "stock": 3, "is_active": True},
            {"variant_id": 22, "product_id": 2, "stock": 4, "is_active": False},
            {"variant_id": 31, "product_id": 3, "stock": 9, "is_active": False},
            {"variant_id": 41, "product_id": 4, "stock": 0, "is_active": True},
        ],
    )
    out = rows_by(catalog.available_stock(t), "product_id")
    assert (out[1]["available_stock"], out[1]["has_variants"]) == (7, False)
    assert (out[2]["available_stock"], out[2]["has_variants"]) == (3, True)
    assert (out[3]["available_stock"], out[3]["has_variants"]) == (7, False)  # all inactive -> own stock
    assert (out[4]["available_stock"], out[4]["has_variants"]) == (0, True)
    labels = rows_by(catalog.stock_label(t), "product_id")
    assert labels[2]["label"] == "Últimas 3 unidades" and labels[4]["label"] == "Agotado"
    bands = rows_by(catalog.stock_band(t), "product_id")
    assert bands[1]["band"] == "in-stock" and bands[2]["band"] == "low-stock" and bands[4]["band"] == "out-of-stock"


# paging
def test_s12_paging(spark):
    t = make_tables(spark, categories=CATS, products=[product(i, 1, price=f"{i}.00") for i in range(1, 12)])
    pages = [catalog.catalog_page(t, sort="price-asc", page=p, limit=5).collect() for p in (1, 2, 3)]
    ids = [r.product_id for page in pages for r in page]
    assert ids == list(range(1, 12))
    assert catalog.catalog_page(t, page=99, limit=5).count() == 0
    assert catalog.catalog_page(t, limit=0).count() == 0
    with pytest.raises(ValueError):
        catalog.catalog_page(t, page=-1, limit=5)
    assert [r.product_id for r in catalog.catalog_page(t, sort="price-asc", show_all=True).collect()] == ids
    assert customers.clv_params(-1, 500) == (1, 500)  # page<1: limit unchecked
    assert customers.clv_params(0, 500) == (1, 20)  # 0 is falsy: page 1, then the limit rule
    assert customers.clv_params(2, 101) == (2, 20)
    assert customers.clv_params(3, 0) == (3, 20)


# Wildcards and collation
def test_s13_s14_wildcards_and_collation(spark):
    t = make_tables(
        spark,
        categories=[
            {"category_id": 1, "category_name": "Zapatos", "slug": "z"},
            {"category_id": 2, "category_name": "Árboles", "slug": "a"},
            {"category_id": 3, "category_name": "Bolsas", "slug": "b"},
        ],
        products=[
            product(1, 1, name="50% Jade"), product(2, 1, name="Jade_Verde"), product(3, 1, name="Jadeíta", description=None),
        ],
    )
    assert {r.product_id for r in catalog.search_products(t, "%", show_all=True).collect()} == {1, 2, 3}
    assert {r.product_id for r in catalog.search_products(t, "jade_", show_all=True).collect()} == {2, 3}
    assert [r.category_name for r in catalog.category_list(t).collect()] == ["Árboles", "Bolsas", "Zapatos"]


# reviews
def test_s15_s16_reviews(spark):
    t = make_tables(
        spark,
        customers=[{"customer_id": 1, "first_name": "A", "last_name": "B", "email": "a@x"}],
        products=[product(1, 1), product(2, 1), product(3, 1)],
        product_reviews=[
            {"review_id": 1, "product_id": 1, "customer_id": 1, "rating": 4, "is_approved": True, "created_at": ts("2024-01-01 00:00:00")},
            {"review_id": 2, "product_id": 1, "customer_id": 1, "rating": 5, "is_approved": True, "created_at": ts("2024-01-02 00:00:00")},
            {"review_id": 3, "product_id": 1, "customer_id": None, "rating": 1, "is_approved": True, "created_at": ts("2024-01-03 00:00:00")},
            {"review_id": 4, "product_id": 2, "customer_id": 1, "rating": 1, "is_approved": False, "created_at": ts("2024-01-03 00:00:00")},
        ],
    )
    r = rows_by(catalog.product_ratings(t), "product_id")
    assert (r[1]["review_count"], r[1]["average_rating"]) == (2, 4.5)
    assert (r[2]["review_count"], r[2]["average_rating"]) == (0, 0.0)
    detail = rows_by(catalog.product_detail_parts(t), "product_id")
    assert [x.review_id for x in detail[1]["reviews"]] == [2, 1]  # newest first, anonymous dropped
    assert detail[3]["reviews"] == [] and detail[3]["variants"] == []


# Cart merge
def test_s17_cart_merge(spark):
    t = make_tables(
        spark,
        products=[product(1, 1, stock=20), product(2, 1, stock=4), product(3, 1, stock=0), product(4, 1, active=False)],
        cart_items=[
            {"id": 100, "customer_id": 7, "product_id": 1, "quantity": 10, "size": "M", "color": ""},
            {"id": 101, "customer_id": 7, "product_id": 2, "quantity": 1, "size": None, "color": ""},
            {"id": 102, "customer_id": 7, "product_id": 1, "quantity": 2, "size": "N", "color": ""},
        ],
    )
    batch = spark.createDataFrame(
        [
            (7, 1, "M", "", 9, 1),     # existing: min(10 + 9, 15, 20) = 15
            (7, 1, "S", "", 20, 2),    # a new line above 15 breaks the CHECK
            (7, 1, "S", "", 3, 3),     # the next one starts the line
            (7, 1, "S", "", 20, 4),    # and now 20 more are capped
            (7, 2, "", "", 3, 5),      # new key, under stock 4 -> 3
            (7, 2, "", "", 3, 6),      # repeated -> min(6, 15, 4) = 4
            (7, 2, None, "", 1, 7),    # NULL size never matches the existing NULL-size line
            (7, 2, None, "", 2, 8),    # nor the line just inserted
            (7, 3, "", "", 1, 9),      # stock 0 -> 0 -> reject
            (7, 4, "", "", 1, 10),     # inactive
            (7, 9, "", "", 1, 11),     # unknown
            (7, 1, "N", "", None, 12),  # missing and negative quantities leave a line alone
            (7, 1, "N", "", -1, 13),
            (7, 1, "O", "", None, 14),
        ],
        "customer_id long, product_id long, size string, color string, quantity int, arrival long",
    )
    rows = carts.cart_merge(t, batch).collect()
    out = {(r.product_id, r.size): r for r in rows if r.size is not None}
    assert (out[(1, "M")].action, out[(1, "M")].new_quantity, out[(1, "M")].line_id) == ("update", 15, 100)
    assert (out[(1, "S")].action, out[(1, "S")].new_quantity, out[(1, "S")].requests, out[(1, "S")].accepted) == ("insert", 15, 3, 2)
    assert (out[(2, "")].action, out[(2, "")].new_quantity) == ("insert", 4)
    assert sorted(r.new_quantity for r in rows if r.size is None) == [1, 2]
    assert out[(3, "")].action == "reject"
    assert out[(4, "")].reason == "inactive product"
    assert out[(9, "")].reason == "unknown product"
    assert (out[(1, "N")].action, out[(1, "N")].old_quantity, out[(1, "N")].new_quantity) == ("reject", 2, None)
    assert (out[(1, "O")].action, out[(1, "O")].reason) == ("reject", "invalid quantity")
    empty = spark.createDataFrame([], "customer_id long, product_id long, size string, color string, quantity int")
    assert carts.cart_merge(t, empty).count() == 0
    assert sorted(map(str, carts.cart_merge_snapshot(t, empty).collect())) == sorted(map(str, t.cart_items.collect()))


# pricing
def test_s18_pricing(spark):
    t = make_tables(
        spark,
        promotions=[
            {"promo_id": 1, "promo_code": "P", "discount_type": "percentage", "discount_value": D("15.00")},
            {"promo_id": 3, "promo_code": "F", "discount_type": "fixed", "discount_value": D("50.00")},
        ],
        orders=[order(1), order(2, promo=1), order(3, promo=3), order(4, promo=3, currency="USD")],
        order_items=[item(o, 1, 3, "33.35") for o in (1, 2, 3, 4)],
    )
    out = rows_by(pricing.price_orders(t), "order_id")
    assert out[1]["total"] == 100.05 and out[1]["discount_applied"] == 0.0
    assert out[2]["discount_applied"] == 15.01 and out[2]["total"] == 85.04  # 15.0075 / 85.0425
    assert out[3]["total"] == 50.05
    assert out[4]["discount_applied"] == 6.4 and out[4]["total"] == 93.65


# Product input
def test_s19_product_input(spark):
    t = make_tables(spark, categories=[{"category_id": 2, "category_name": "b", "slug": "b"}])
    batch = spark.createDataFrame(
        [
            (1, "Jarrón", None, "0", "3", "2", None, None),
            (2, "Jarrón", None, "12abc", "3", "2", None, None),
            (3, "", None, "10", "3", "2", None, None),
            (4, " Vaso ", " hecho a mano ", "10.5", "x", "2", "true", "  "),
            (5, "Plato", None, "10", "-1", "2", "true", None),
            (6, "Plato", None, "10", "1", "77", "true", None),
        ],
        "form_id long, product_name string, description string, price string, stock string, category_id string, is_active string, image_url string",
    )
    out = rows_by(ingest.clean_products(t, batch), "form_id")
    assert out[1]["reason"] == "name, price and category are required"
    assert out[2]["reason"] == "invalid price"
    assert out[3]["status"] == "rejected"
    assert out[4]["status"] == "accepted" and out[4]["product_name"] == "Vaso" and out[4]["stock"] == 0
    assert out[4]["description"] == "hecho a mano" and out[4]["image_url"] is None and out[4]["is_active"]
    assert out[5]["reason"] == "negative price or stock"
    assert out[6]["reason"] == "invalid category"  # it does not exist
    assert out[1]["is_active"] is False


# slugs
def test_s20_slugs(spark):
    t = make_tables(
        spark,
        categories=[
            {"category_id": 1, "category_name": "Joyería", "slug": "joyería"},
            {"category_id": 2, "category_name": "Decoración del Hogar", "slug": "decoración-del-hogar"},
            {"category_id": 3, "category_name": "Ropa", "slug": "ropa"},
        ],
        products=[product(1, 1, name="Collar de Jade Ñandutí!")],
    )
    slugs = {(r.kind, r.id): r.slug for r in ingest.slugify(t).collect()}
    assert slugs[("category", 1)] == "joyería" and slugs[("category", 2)] == "decoración-del-hogar"
    assert slugs[("product", 1)] == "collar-de-jade-anduti-1"
    broken = {r.slug for r in ingest.slug_consistency(t).collect()}
    assert broken == {"joyería", "decoración-del-hogar"}


# CSV export round trip
def test_s21_csv_round_trip(spark, tmp_path):
    from vitrina.sinks import write_csv

    df = spark.createDataFrame([(1, 'x"y', None, "", "a,b\nc")], "a int, b string, c string, d string, e string")
    out = str(tmp_path / "csv")
    write_csv(df, out)
    parts = [p.read_text() for p in sorted((tmp_path / "csv").glob("part-*.csv"))]
    # every part file carries the (quoted) header; one holds the data row
    assert all(p.startswith('"a","b","c","d","e"\n') for p in parts)
    assert sum(p.count('"1","x""y","","","a,b\nc"') for p in parts) == 1
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out).collect()[0]
    assert back["b"] == 'x"y' and back["e"] == "a,b\nc"


def test_abbreviation_ladder(spark):
    df = spark.createDataFrame(
        [(D("999.994"),), (D("1000.00"),), (D("1250.00"),), (D("3000000.00"),), (D("4500000000.00"),), (D("7100000000000.00"),)],
        "x decimal(20,2)",
    )
    got = [r.f for r in df.select(export.abbreviate(df["x"]).alias("f")).collect()]
    assert got == ["999.99", "1K", "1.3K", "3M", "4.5B", "7.1T"]
    short = [r.f for r in df.select(export.abbreviate(df["x"], export.LADDER_SHORT).alias("f")).collect()]
    assert short[-1] == "7100000M"


def test_product_detail_splits_long_lists(spark):
    t = make_tables(
        spark,
        customers=[{"customer_id": 1, "first_name": "A", "last_name": "B", "email": "a@x"}],
        products=[product(1, 1)],
        product_reviews=[
            {"review_id": i, "product_id": 1, "customer_id": 1, "rating": 5, "is_approved": True,
             "created_at": ts(f"2024-01-{i:02d} 00:00:00")}
            for i in range(1, 21)
        ],
    )
    rows = sorted(catalog.product_detail_parts(t, chunk=6).collect(), key=lambda r: r.part)
    assert [len(r.reviews) for r in rows] == [6, 6, 6, 2] and [r.part for r in rows] == [0, 1, 2, 3]
    assert [x.review_id for r in rows for x in r.reviews] == list(range(20, 0, -1))  # the parts are the list
    one = spark.createDataFrame([(1,), (5,)], "product_id long")
    assert catalog.product_detail_parts(t, chunk=100, ids=one).count() == 1


# Mixed currencies are added as the shop does; per-currency split and USD view
def test_s2_mixed_currency(spark):
    t = make_tables(
        spark,
        orders=[order(1, total="100.00", currency="GTQ"), order(2, total="10.00", currency="USD"),
                order(3, "Cancelado", total="7.00", currency="USD")],
    )
    per = {r.currency_code: (r.total_orders, r.revenue) for r in reports.sales_by_currency(t).collect()}
    assert per == {"GTQ": (1, 100.0), "USD": (1, 10.0)}
    assert reports.kpis(t).collect()[0].total_revenue == 110.0  # added without conversion
    usd = {r.order_id: r.amount_usd for r in pricing.convert_currency(t).collect()}
    assert usd == {1: 12.8, 2: 10.0, 3: 7.0}
    assert {r.currency_code: r.total for r in reports.orders_by_currency_all(t).collect()} == {"GTQ": 1, "USD": 2}
