"""Batch jobs against a replay of their batch, one request after the other, in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from tests.conftest import SF0001
from vitrina.operators import carts, catalog, ingest, quality
from vitrina.plans.registry import tables_for

from tests.fixtures import D, make_tables, ts


@pytest.fixture(scope="module")
def t(spark):
    return tables_for(spark, SF0001)


def replay_cart(t, batch, most=None):
    """Cart lines per owner after the shop's rules for each request; (quantity, requests, accepted) per key."""
    products = {r.product_id: (r.stock, r.is_active) for r in t.products.collect()}
    lines, out = {}, {}
    for r in sorted(t.cart_items.collect(), key=lambda r: r.id):
        for owner in [("customer", str(r.customer_id))] * (r.customer_id is not None) + [("session", r.session_id)] * (r.session_id is not None):
            lines.setdefault((*owner, r.product_id, r.size, r.color), r.quantity)
    old = dict(lines)
    for r in sorted(batch.collect(), key=lambda r: r.arrival):
        d = r.asDict()
        owner = ("customer", str(d["customer_id"])) if d["customer_id"] is not None else ("session", d["session_id"])
        key = (*owner, r.product_id, r.size, r.color)
        seen = out.setdefault(key, [old.get(key), None, 0, 0])
        seen[2] += 1
        q = r.quantity
        if q is None or q < 1 or (most and q > 15):
            continue
        if most and len({k[2] for k in lines if k[:2] == owner}) >= most:
            continue
        stock, active = products.get(r.product_id, (0, False))
        new = min(lines[key] + q, 15, stock) if key in lines else min(q, stock)
        if active and 1 <= new <= 15:
            lines[key] = seen[1] = new
            seen[3] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("most", [None, 5, 20])
def test_carts(t, most):
    batch = carts.add_batch(t) if most else carts.guest_sync_batch(t)
    rows = (carts.cart_add(t, batch, max_products=most) if most else carts.cart_merge(t, batch)).collect()
    got = {(r.owner_type, r.owner_id, r.product_id, r.size, r.color): (r.old_quantity, r.new_quantity, r.requests, r.accepted) for r in rows}
    assert got == replay_cart(t, batch, most)


def test_cart_snapshot_after_additions(t):
    result = carts.cart_add(t, max_products=20).cache()
    after = carts.cart_merge_snapshot(t, result=result)
    inserted = result.filter("action = 'insert'").count()
    assert after.count() == t.cart_items.count() + inserted
    assert after.filter("session_id IS NULL AND customer_id IS NULL").count() == 0


def test_product_changes(t):
    batch = ingest.product_change_batch(t).cache()
    shop = {r.product_id: {c: r[c] for c in ingest.PRODUCT_VALUES} for r in t.products.collect()}
    was, seen = set(shop), {}
    order = {"insert": 0, "update": 1, "delete": 2}
    for r in sorted(batch.collect(), key=lambda r: (r.seq, order[r.op])):
        last = seen.setdefault(r.product_id, [None])
        if r.op == "insert":
            if r.product_id in shop:
                continue
            shop[r.product_id] = {c: r[c] for c in ingest.PRODUCT_VALUES}
        elif r.product_id not in shop:
            continue
        elif r.op == "update":
            shop[r.product_id] = {c: r[c] for c in ingest.PRODUCT_VALUES}
        else:
            shop[r.product_id] = shop[r.product_id] | {"is_active": False}
        last[0] = r.op
    got = ingest.apply_product_changes(t, batch).collect()
    assert {r.product_id for r in got} == set(seen)
    for r in got:
        op = seen[r.product_id][0]
        want = "not found" if op is None else "deleted" if op == "delete" else "updated" if r.product_id in was else "created"
        assert r.result == want
        if op:
            assert {c: r[c] for c in ingest.PRODUCT_VALUES} == shop[r.product_id] | {"price": float(shop[r.product_id]["price"])}
    snapshot = {r.product_id: r for r in ingest.product_snapshot_after_changes(t, batch).collect()}
    assert {k: {c: v[c] for c in ingest.PRODUCT_VALUES} for k, v in snapshot.items()} == shop


def test_registrations(t):
    batch = ingest.registration_batch(t).cache()
    known = {r.email.lower() for r in t.customers.collect()}
    want = {}
    for r in sorted(batch.collect(), key=lambda r: r.arrival):
        text = lambda v: (v or "").strip(" ")
        first, last, email = text(r.first_name), text(r.last_name), text(r.email).lower()
        ok = first and last and email and r.password and re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", email)
        ok = ok and r.password == r.password_confirm and len(r.password) >= 8 and email not in known
        if ok:
            known.add(email)
        want[r.request_id] = "accepted" if ok else "rejected"
    assert {r.request_id: r.status for r in ingest.clean_customers(t, batch).collect()} == want


def replay_logins(t, logins):
    accounts, by_email, out = {}, {}, []
    for r in sorted(t.customers.collect(), key=lambda r: r.customer_id):
        accounts[r.customer_id] = {"google": r.google_id, "facebook": r.facebook_id}
        by_email.setdefault((r.email or "").lower(), r.customer_id)
    for r in sorted(logins.collect(), key=lambda r: r.arrival):
        if r.provider not in ("google", "facebook"):
            out.append((r.arrival, "reject", None))
            continue
        holder = next((a for a, ids in accounts.items() if r.provider_id is not None and ids[r.provider] == r.provider_id), None)
        if holder is not None:
            out.append((r.arrival, "login", holder))
            continue
        if r.email is None:  # the shop's insert fails
            out.append((r.arrival, "reject", None))
            continue
        email = r.email.lower()
        if email in by_email:
            accounts[by_email[email]][r.provider] = r.provider_id
            out.append((r.arrival, "link", by_email[email]))
        else:
            by_email[email] = f"new {email}"
            accounts[f"new {email}"] = {"google": None, "facebook": None, r.provider: r.provider_id}
            out.append((r.arrival, "create", f"new {email}"))
    return [(a, action, c if isinstance(c, int) else None) for a, action, c in out]


def test_logins(t):
    logins = ingest.oauth_login_batch(t)
    got = sorted((r.arrival, r.action, r.customer_id) for r in ingest.link_identities(t, logins).collect())
    assert got == sorted(replay_logins(t, logins))


def test_logins_repeated_and_by_two_providers(spark):
    t = make_tables(spark, customers=[{"customer_id": 7, "email": "ana@x.org", "first_name": "Ana", "google_id": "g7"}])
    logins = spark.createDataFrame(
        [(1, "google", "n1", "new@x.org"), (2, "google", "n1", "New@x.org"), (3, "facebook", "f1", "new@x.org"), (4, "google", "g8", "ANA@x.org"),
         (5, "google", "g7", "ana@x.org"), (6, "google", "g7", "other@x.org"), (7, "facebook", "f1", "new@x.org"), (8, "facebook", "f2", "ana@x.org")],
        "arrival long, provider string, provider_id string, email string",
    )
    got = sorted((r.arrival, r.action, r.customer_id) for r in ingest.link_identities(t, logins).collect())
    assert got == sorted(replay_logins(t, logins))


@pytest.mark.parametrize("seed", range(6))
def test_logins_with_moved_ids(spark, seed):
    """Random batches in which ids move between accounts, e-mails lack and stored ids come with other e-mails."""
    rng = random.Random(seed)
    customers = [
        {"customer_id": k, "email": f"c{k % 9}@x.org", "google_id": f"g{k}" if k % 2 else None, "facebook_id": f"f{k}" if k % 3 else None} for k in range(1, 12)
    ]
    t = make_tables(spark, customers=customers)
    ids, emails = [None, *(f"g{k}" for k in range(8 + seed)), *(f"f{k}" for k in range(6))], [None, *(f"c{k}@X.org" for k in range(9)), *(f"new{k}@x.org" for k in range(5 + 4 * seed))]
    rows = [(k, rng.choice(["google", "google", "facebook", "other" if rng.random() < 0.1 else "google"]), rng.choice(ids), rng.choice(emails)) for k in range(250)]
    logins = spark.createDataFrame(rows, "arrival long, provider string, provider_id string, email string")
    got = sorted(((r.arrival, r.action, r.customer_id) for r in ingest.link_identities(t, logins).collect()), key=str)
    assert got == sorted(replay_logins(t, logins), key=str)


def test_a_chain_of_moves(spark):
    """Every login depends on the one before: the rounds go on until the end of the chain."""
    t = make_tables(spark, customers=[{"customer_id": k, "email": f"c{k}@x.org", "google_id": f"g{k}"} for k in range(1, 8)])
    rows = [(k, "google", f"g{k}", f"c{k + 1}@x.org") for k in range(1, 7)]
    rows = [(0, "google", "fresh", "c1@x.org"), *rows, *((20 + a, "google", f"g{k}", "c9@x.org") for a, (_, _, _, _) in enumerate(rows) for k in [a + 1])]
    logins = spark.createDataFrame(rows, "arrival long, provider string, provider_id string, email string")
    got = sorted(((r.arrival, r.action, r.customer_id) for r in ingest.link_identities(t, logins).collect()), key=str)
    assert got == sorted(replay_logins(t, logins), key=str)


def test_equal_logins_and_one_hot_id(spark):
    t = make_tables(spark, customers=[{"customer_id": 1, "email": "a@x.org", "google_id": "g1"}])
    rows = [(1, "google", "n1", "new@x.org")] * 3 + [(2, "google", None, None)] * 2 + [(3, "google", "n2", None)] * 2 + [(10 + k, "google", "hot", f"c{k}@x.org") for k in range(300)]
    logins = spark.createDataFrame(rows, "arrival long, provider string, provider_id string, email string")
    got = sorted(((r.arrival, r.action, r.customer_id) for r in ingest.link_identities(t, logins).collect()), key=str)
    assert got == sorted(replay_logins(t, logins), key=str)


def test_every_foreign_key_reports_its_own_orphans(spark):
    t = make_tables(
        spark,
        products=[{"product_id": 1, "category_id": 9}],
        order_items=[{"order_id": 5, "product_id": k} for k in (1, 2, 3)],
        product_reviews=[{"review_id": k, "product_id": 4, "customer_id": None} for k in range(3)],
        cart_items=[{"id": 1, "product_id": 8, "customer_id": 6}],
        payments=[{"order_id": 5}, {"order_id": None}],
        product_variants=[{"variant_id": 1, "product_id": 1}],
    )
    got = {(r.table_name, r.rule.split(" ")[0]): r.violations for r in quality.referential_audit(t).collect() if r.violations}
    assert got == {
        ("products", "category_id"): 1, ("order_items", "order_id"): 3, ("order_items", "product_id"): 2, ("product_reviews", "product_id"): 3,
        ("cart_items", "product_id"): 1, ("cart_items", "customer_id"): 1, ("payments", "order_id"): 1,
    }


def test_every_constraint_and_unique_key_once(spark):
    t = make_tables(
        spark,
        categories=[{"category_id": 1, "category_name": None, "slug": "a"}],
        products=[{"product_id": 1, "price": D(-1), "wholesale_price": D(-1), "stock": -1}, {"product_id": 2, "product_name": "b", "category_id": 1}],
        product_variants=[{"variant_id": 1, "stock": -1}, {"variant_id": 2}],
        product_reviews=[{"review_id": 1, "rating": 6}, {"review_id": 2}],
        customers=[{"customer_id": 1, "google_id": "g", "facebook_id": "f"}, {"customer_id": 2, "email": "a", "first_name": "b", "last_name": "c", "google_id": "g", "facebook_id": "f"}],
        orders=[{"order_id": 1, "total": D(-1), "status": "?", "shipping_status": "?", "currency_code": "Q"}, {"order_id": 2}],
        order_items=[{"order_id": 1, "quantity": 0, "unit_price": D(-1)}, {"order_id": 2}],
        payments=[{"order_id": 1, "amount": D(0), "status": "?"}, {"order_id": 2}],
        cart_items=[{"id": 1, "quantity": 16, "customer_id": 1}, {"id": 2}],
        promotions=[{"promo_id": 1, "discount_type": "?", "discount_value": D(0)}],
        countries=[{"country_id": 1, "country_name": "a"}, {"country_id": 2, "country_name": "a"}],
    )
    rows = quality.constraint_audit(t).collect()
    assert {(r.table_name, r.rule): r.violations for r in rows if r.violations != 1} == {}
    keys = {r.rule: r.violations for r in quality.uniqueness_audit(t).collect()}
    assert keys["unique(google_id)"] == keys["unique(facebook_id)"] == keys["unique(country_name)"] == 1


def test_search_reads_backslashes_as_the_shop_does(spark):
    names = ["a\\b", "ab", "a%b", "axb"]
    t = make_tables(spark, products=[{"product_id": k, "product_name": n, "category_id": 1, "is_active": True} for k, n in enumerate(names)])
    find = lambda term: sorted(r.product_name for r in catalog.search_products(t, term, show_all=True).collect())
    assert find("a\\b") == ["ab"] and find("a\\\\b") == ["a\\b"] and find("a\\%b") == ["a%b"]
    assert find("a%b") == sorted(names) and find("a_b") == ["a%b", "a\\b", "axb"]


def test_names_sort_linguistically_and_pages_follow_keys(spark):
    names = ["Zapato", "a\\b", "Ánfora", "anillo", "árbol", "Banco", None, "zócalo"]
    t = make_tables(
        spark,
        products=[
            {"product_id": k, "product_name": n, "category_id": 1, "price": D(k % 3), "is_active": True, "created_at": None if k % 4 == 0 else ts(f"2024-01-0{k}")}
            for k, n in enumerate(names)
        ],
    )
    got = [r.product_name for r in catalog.catalog_page(t, sort="name", limit=20).collect()]
    assert [n for n in got if n] == ["a\\b", "Ánfora", "anillo", "árbol", "Banco", "Zapato", "zócalo"]
    for sort, (column, _) in catalog.SORT_OPTIONS.items():
        every = [r.product_id for r in catalog.catalog_page(t, sort=sort, show_all=True).collect()]
        pages, last = [], None
        for number in range(1, 5):
            page = catalog.catalog_page(t, sort=sort, page=number, limit=3).collect()
            keyed = catalog.catalog_page(t, sort=sort, limit=3, after=last).collect()
            assert page == keyed
            pages += [r.product_id for r in page]
            if not page:
                break
            last = (D(page[-1].price) if column == "price" else page[-1][column], page[-1].product_id)
        assert pages == every


def test_stock_is_added_up_for_the_page_only(t):
    lines = catalog.catalog_page(t, sort="price-asc", page=2, limit=10)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))

    def below(k):
        end = next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(lines[k])), len(lines))
        return "\n".join(lines[k + 1 : end])

    limits = [k for k, line in enumerate(lines) if "GlobalLimit" in line]
    sums = [k for k, line in enumerate(lines) if "Aggregate" in line and "sum(stock" in line]
    assert limits and sums
    assert not any("sum(stock" in below(k) for k in limits)
    assert all("LeftSemi" in below(k) and "GlobalLimit" in below(k) for k in sums)


def test_pages_of_totals(t):
    total = catalog.search_total(t, "Gear").first()
    assert total.total_pages == -(-total.total // 10)
    assert catalog.admin_total(t, show_all=True).first().total_pages == 1
