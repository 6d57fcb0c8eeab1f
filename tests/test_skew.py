"""A hot key: one product holds most item rows. With broadcasts off and low
skew thresholds, AQE must split the skewed join and the result must not change."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tests.fixtures import make_tables
from vitrina.operators import reports


def _tables(spark):
    products = [
        {"product_id": p, "product_name": f"p{p}", "category_id": 1 + p % 3, "price": Decimal("1.00"), "stock": 5,
         "is_active": True}
        for p in range(1, 31)
    ]
    cats = [{"category_id": c, "category_name": f"C{c}", "slug": f"c{c}"} for c in (1, 2, 3)]
    orders, items = [], []
    for o in range(1, 3001):
        orders.append({"order_id": o, "customer_id": o % 50, "shipping_address_id": None,
                       "order_date": dt.datetime(2024, 1, 1), "status": "Cancelado" if o % 97 == 0 else "Entregado",
                       "total": Decimal("1.00"), "currency_code": "GTQ"})
        items.append({"order_id": o, "line_no": 1, "product_id": 1, "quantity": 1, "unit_price": Decimal("2.00")})
        if o <= 300:
            items.append({"order_id": o, "line_no": 2, "product_id": 2 + o % 29, "quantity": 2, "unit_price": Decimal("3.00")})
    return make_tables(spark, categories=cats, products=products, orders=orders, order_items=items)


def test_hot_product_is_split_and_result_unchanged(spark):
    t = _tables(spark)
    expected = sorted(reports.sales_by_category(t).collect())
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = reports.sales_by_category(t)
        got = sorted(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == expected
    assert "isSkewJoin=true" in plan or "skew=true" in plan
