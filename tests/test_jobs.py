"""Branch coverage for the batch jobs on hand-written fixtures."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tests.fixtures import make_tables
from vitrina.operators import carts, ingest


def _shop(spark):
    return make_tables(
        spark,
        products=[
            {"product_id": 1, "product_name": "a", "category_id": 1, "price": Decimal("1.00"), "stock": 9, "is_active": True},
            {"product_id": 2, "product_name": "b", "category_id": 1, "price": Decimal("1.00"), "stock": 0, "is_active": True},
            {"product_id": 3, "product_name": "c", "category_id": 1, "price": Decimal("1.00"), "stock": 9, "is_active": False},
        ],
        customers=[
            {"customer_id": 7, "email": "Ana@X.org", "first_name": "Ana", "last_name": "B", "google_id": "g7"},
            {"customer_id": 8, "email": "ana@x.org", "first_name": "Ana", "last_name": "C"},
            {"customer_id": 9, "email": "luis@x.org", "first_name": "Luis", "last_name": "D", "facebook_id": "f9"},
        ],
        cart_items=[
            {"id": 1, "customer_id": 7, "product_id": 1, "quantity": 2, "size": "", "color": "",
             "updated_at": dt.datetime(2024, 1, 1)},
            {"id": 2, "customer_id": 7, "product_id": 2, "quantity": 1, "size": "", "color": "",
             "updated_at": dt.datetime(2024, 1, 1)},
            {"id": 3, "customer_id": 7, "product_id": 3, "quantity": 1, "size": "", "color": "",
             "updated_at": dt.datetime(2024, 1, 1)},
            {"id": 4, "session_id": "s5", "product_id": 1, "quantity": 1, "size": "", "color": "",
             "updated_at": dt.datetime(2024, 1, 15)},
            {"id": 5, "session_id": "s6", "product_id": 1, "quantity": 1, "size": "", "color": "",
             "updated_at": dt.datetime(2024, 1, 16)},
            {"id": 6, "session_id": "s6", "customer_id": 9, "product_id": 1, "quantity": 1, "size": "", "color": "",
             "updated_at": dt.datetime(2023, 1, 1)},
        ],
    )


def test_set_quantity_branches(spark):
    t = _shop(spark)
    req = spark.createDataFrame(
        [(1, "customer", "7", 20), (1, "customer", "7", 0), (1, "customer", "7", 12), (2, "customer", "7", 3),
         (3, "customer", "7", 3), (1, "customer", "8", 3), (4, "session", "s5", 4), (6, "session", "s6", 2)],
        "id long, owner_type string, owner_id string, quantity int",
    )
    out = [(r.id, r.owner_id, r.requested, r.new_quantity, r.action, r.reason) for r in carts.cart_set_quantity(t, req).collect()]
    assert (1, "7", 20, None, "reject", "invalid quantity") in out
    assert (1, "7", 0, None, "reject", "invalid quantity") in out
    assert (1, "7", 12, 9, "update", None) in out  # capped by stock 9
    assert (2, "7", 3, None, "reject", "quantity out of range") in out  # stock 0
    assert (3, "7", 3, None, "reject", "inactive product") in out
    assert (1, "8", 3, None, "reject", "item not found") in out  # not the owner
    assert (4, "s5", 4, 4, "update", None) in out
    assert (6, "s6", 2, 2, "update", None) in out  # a line with both owners answers to its session


def test_remove_and_retention(spark):
    t = _shop(spark)
    req = spark.createDataFrame(
        [(1, "customer", "7"), (1, "customer", "8"), (4, "session", "s5"), (99, "customer", "7")],
        "id long, owner_type string, owner_id string",
    )
    out = {(r.id, r.owner_id): (r.removed, r.reason) for r in carts.cart_remove(t, req).collect()}
    assert out == {(1, "7"): (True, None), (1, "8"): (False, "item not found"), (4, "s5"): (True, None),
                   (99, "7"): (False, "item not found")}
    assert sorted(r.id for r in carts.cart_remove_snapshot(t, req).collect()) == [2, 3, 5, 6]
    expired = {r.id for r in carts.retention_cleanup(t, as_of="2024-02-15 00:00:00").filter("expired").collect()}
    assert expired == {4}  # guest, idle > 30 days; id 5 is 30 days minus a day old; id 6 has a customer


def test_clean_customers_branches(spark):
    t = _shop(spark)
    batch = spark.createDataFrame(
        [("r1", " Eva ", "Paz", " EVA@x.org ", ""), ("r2", "Eva", "Paz", "eva@x.org", "555"),
         ("r3", "Ana", "B", "ANA@x.ORG", None), ("r4", "", "Q", "q@x.org", None), ("r5", "Q", "R", "q@x", None)],
        "request_id string, first_name string, last_name string, email string, phone string",
    )
    out = {r.request_id: (r.status, r.reason, r.email, r.first_name, r.phone) for r in ingest.clean_customers(t, batch).collect()}
    assert out["r1"] == ("accepted", None, "eva@x.org", "Eva", None)
    assert out["r2"][:2] == ("rejected", "email repeated in batch")
    assert out["r3"][:2] == ("rejected", "email already registered")
    assert out["r4"][:2] == ("rejected", "all fields are required")
    assert out["r5"][:2] == ("rejected", "invalid email")


def test_link_identities_branches(spark):
    t = _shop(spark)
    logins = spark.createDataFrame(
        [("google", "g7", "other@x.org"), ("google", "gX", "ANA@x.org"), ("facebook", "f9", "luis@x.org"),
         ("facebook", "fZ", "new@x.org")],
        "provider string, provider_id string, email string",
    )
    out = {r.provider_id: (r.action, r.customer_id) for r in ingest.link_identities(t, logins).collect()}
    assert out == {"g7": ("login", 7), "gX": ("link", 7), "f9": ("login", 9), "fZ": ("create", None)}


def test_snapshots_after_set_quantity_and_retention(spark):
    t = _shop(spark)
    req = spark.createDataFrame(
        [(1, "customer", "7", 4), (1, "customer", "7", 6), (2, "customer", "7", 3), (4, "session", "s5", 2)],
        "id long, owner_type string, owner_id string, quantity int",
    )
    after = {r.id: r.quantity for r in carts.cart_set_quantity_snapshot(t, req).collect()}
    assert after == {1: 6, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}  # line 2 rejected (stock 0) keeps its quantity
    kept = {r.id for r in carts.retention_snapshot(t, as_of="2024-02-15 00:00:00").collect()}
    assert kept == {1, 2, 3, 5, 6}
