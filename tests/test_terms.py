"""Promotion admission, dated rates, shipping quotes and the retention stream on small fixtures."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import D, make_tables, ts
from vitrina.operators import carts, terms
from vitrina.streaming import retention

DAY = dt.datetime(2024, 1, 1)


def test_first_uses_of_a_hot_code(spark):
    """One code has 90 % of the orders, many at one moment; ids and moments tie across levels."""
    rng = random.Random(1)
    orders = [
        {"order_id": k * rng.choice([1, 1, 3000]), "promo_id": 1 if rng.random() < 0.9 else 2, "status": rng.choice(["Pendiente", "Enviado", "Cancelado"]),
         "order_date": DAY + dt.timedelta(days=rng.choice([0, 0, 0, 1, 40, 41])), "total": D(1)}
        for k in range(1, 1500)
    ]
    orders = list({o["order_id"]: o for o in orders}.values())
    t = make_tables(spark, orders=orders, order_items=[{"order_id": o["order_id"], "line_no": 1, "product_id": 1, "quantity": 1, "unit_price": D(o["order_id"] % 9)} for o in orders[::2]])
    for quota in (0, 1, 137, 600, 5000):
        rules = spark.createDataFrame([(1, D("2.00"), quota, None, None, True), (2, D(0), 5, None, None, True)], "promo_id int, min_purchase decimal(10,2), max_uses int, valid_from timestamp_ntz, valid_until timestamp_ntz, is_active boolean")
        got = {r.order_id: r.reason for r in terms.promotion_admission(t, rules).collect()}
        spent = {o["order_id"]: o["order_id"] % 9 for o in orders[::2]}
        used, want = {1: 0, 2: 0}, {}
        for o in sorted(orders, key=lambda o: (o["order_date"], o["order_id"])):
            if o["status"] == "Cancelado":
                continue
            i, p = o["order_id"], o["promo_id"]
            if p == 1 and spent.get(i, 0) < 2:
                want[i] = terms.REASON_MINIMUM
            else:
                want[i] = None if used[p] < {1: quota, 2: 5}[p] else terms.REASON_USED_UP
                used[p] += 1
        assert got == want


def test_no_window_holds_a_code(spark):
    t = make_tables(spark)
    plan = terms.promotion_admission(t)._jdf.queryExecution().optimizedPlan().toString()
    numbers = [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition" in line]
    assert numbers and all("_l0" in line and "_l1" in line and "_l2" in line for line in numbers)


def test_rates_as_of(spark):
    """Ties, rows before the first rate, a currency without rates, gaps of days, and a hot day."""
    rng = random.Random(2)
    moment = lambda: DAY + dt.timedelta(days=rng.choice([0, 3, 3, 3, 9, 30]), seconds=rng.choice([0, 1, 5000, 86399]))
    rates = [(k, rng.choice(["GTQ", "EUR"]), "USD", D(f"0.{rng.randint(1, 9999):04d}"), moment() + dt.timedelta(days=1)) for k in range(40)]
    orders = [{"order_id": k, "currency_code": rng.choice(["GTQ", "GTQ", "EUR", "USD", "XXX"]), "order_date": None if k == 7 else moment(), "total": D(f"{k}.35")} for k in range(500)]
    frame = spark.createDataFrame(rates, "rate_id int, from_currency string, to_currency string, rate decimal(10,6), effective_date timestamp_ntz")
    got = {r.order_id: (r.rate, r.amount_usd) for r in terms.dated_conversion(make_tables(spark, orders=orders), frame).collect()}
    for o in orders:
        before = [(at, i, rate) for i, c, _, rate, at in rates if c == o["currency_code"] and o["order_date"] and at <= o["order_date"]]
        rate = D(1) if o["currency_code"] == "USD" else max(before)[2] if before else None
        amount = None if rate is None else float((o["total"] * rate).quantize(D("0.01"), rounding="ROUND_HALF_UP"))
        assert got[o["order_id"]] == (None if rate is None else float(rate), amount)


def test_quotes_by_band_without_a_nested_loop(spark):
    rng = random.Random(3)
    bands = [(k, rng.choice([1, 2]), D(a), None if rng.random() < 0.3 else D(a + rng.choice([0.5, 30, 200])), D(rng.randint(1, 9)), D("0.25"), rng.randint(1, 3), rng.random() < 0.9) for k, a in enumerate(rng.choices([0, 7.5, 50, 99.9, 100, 260, 400], k=12))]
    rates = spark.createDataFrame(bands, "rate_id int, zone_id int, min_weight decimal(10,2), max_weight decimal(10,2), base_cost decimal(10,2), cost_per_kg decimal(10,2), estimated_days int, is_active boolean")
    orders = [{"order_id": k, "shipping_address_id": k % 4} for k in range(80)]
    items = [{"order_id": k, "line_no": 1, "product_id": 1, "quantity": q} for k, q in ((o["order_id"], rng.choice([0, 1, 15, 100, 101, 199, 520, 900, 5000])) for o in orders if o["order_id"] % 9)]
    t = make_tables(
        spark, orders=orders, order_items=items, products=[{"product_id": 1, "stock": 4}], countries=[{"country_id": k, "country_code": c} for k, c in enumerate("ABC")],
        cities=[{"city_id": k, "country_id": k} for k in range(3)], customer_addresses=[{"address_id": k, "customer_id": 1, "city_id": k} for k in range(4)],
        shipping_zones=[{"zone_id": 1, "zone_name": "x", "countries": ["A", "B", "A"]}, {"zone_id": 2, "zone_name": "y", "countries": ["B"]}],
    )
    zones = {0: [1], 1: [1, 2], 2: [], 3: []}
    weight = {i["order_id"]: D(i["quantity"]) * D("0.5") for i in items}
    got = {r.order_id: (r.rate_id, r.shipping_cost) for r in terms.shipping_quotes(t, rates).collect()}
    assert set(got) == {o["order_id"] for o in orders}
    for o in orders:
        w = weight.get(o["order_id"], D(0))
        fits = [(base + per * w, days, i) for i, z, low, high, base, per, days, on in bands if on and z in zones[o["shipping_address_id"]] and low <= w and (high is None or w < high)]
        want = min(fits) if fits else None
        assert got[o["order_id"]] == ((want[2], float(want[0].quantize(D("0.01"), rounding="ROUND_HALF_UP"))) if want else (None, None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = terms.shipping_quotes(t, rates)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("files", [1, 3])
def test_retention_stream_equals_the_batch(spark, tmp_path, files):
    """Lines with several updates, in any order of files: a later update revives a line, a customer's line stays."""
    rng = random.Random(files)
    as_of = dt.datetime(2024, 3, 1)
    rows = []
    for k in range(60):
        at = DAY
        for _ in range(rng.randint(1, 4)):
            at += dt.timedelta(days=rng.choice([1, 29, 30, 31]), microseconds=rng.choice([0, 1]))
            if at < as_of:
                rows.append({"id": k, "session_id": f"s{k}", "customer_id": 5 if k % 10 == 0 else None, "updated_at": at})
    rows.append({"id": 900, "session_id": "s", "customer_id": None, "updated_at": as_of - dt.timedelta(days=30)})
    rows.append({"id": 901, "session_id": "s", "customer_id": None, "updated_at": as_of - dt.timedelta(days=30, microseconds=1)})
    updates = make_tables(spark, cart_items=rows).cart_items
    newest = {r["id"]: r for r in sorted(rows, key=lambda r: r["updated_at"])}
    t = make_tables(spark, cart_items=list(newest.values()))
    # the stream sees every update, the table the last one
    replayed = retention.retention_replay(spark, updates, str(tmp_path / "w"), str(as_of), files=files)
    last = replayed.groupBy("id").agg(F.max(F.struct("updated_at", "expired")).alias("x")).select("id", "x.expired")
    want = {r.id: r.expired for r in carts.retention_cleanup(t, as_of=str(as_of)).collect()}
    assert {r.id: r.expired for r in last.collect()} == want
    assert want[901] and not want[900]


def test_retention_in_steps(spark, tmp_path):
    """A line expires, comes back, and expires again; each ended session is written once."""
    updates = str(tmp_path / "in")
    source = spark.readStream.schema(retention.UPDATE_SCHEMA)
    run = lambda: retention.start_retention(spark, source.parquet(f"{updates}/*"), str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt")).awaitTermination()
    add = lambda name, *rows: spark.createDataFrame(rows, retention.UPDATE_SCHEMA).coalesce(1).write.parquet(f"{updates}/{name}")
    found = lambda: sorted((r.id, str(r.last_update)) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.id is not None)
    add("a", (1, "s", None, ts("2024-01-01")), (2, "s", None, ts("2024-01-20")))
    run()
    add("b", (None, None, None, ts("2024-02-05")))
    run()
    assert found() == [(1, "2024-01-01 00:00:00")]
    add("c", (1, "s", None, ts("2024-02-06")), (2, "s", None, ts("2024-02-06")))
    run()
    add("d", (None, None, None, ts("2024-04-01")))
    run()
    assert found() == [(1, "2024-01-01 00:00:00"), (1, "2024-02-06 00:00:00"), (2, "2024-02-06 00:00:00")]
