"""Shop-shaped sources: an export of the mapped tables reads back into the same reports."""

from __future__ import annotations

import pytest

from tests.conftest import SF0001
from vitrina.operators import catalog, reports
from vitrina.plans.registry import tables_for
from vitrina.sources.shop import SHOP_SCHEMA, load_export


def test_export_round_trip_gives_same_reports(spark, tmp_path):
    t = tables_for(spark, SF0001)
    for table in SHOP_SCHEMA:
        getattr(t, table).write.parquet(str(tmp_path / table))
    back = load_export(spark, str(tmp_path))
    for table in SHOP_SCHEMA:
        assert [f.dataType for f in getattr(back, table).schema.fields] == [
            f.dataType for f in getattr(t, table).schema.fields
        ], table
    for fn in (reports.sales_by_category, reports.kpis, catalog.available_stock, reports.shipping_zone_revenue):
        assert sorted(fn(back).collect()) == sorted(fn(t).collect())


def test_missing_source_columns(spark):
    from vitrina.sources.shop import conform, load_jdbc

    df = conform(spark.createDataFrame([(1, "Jade", "jade", "extra")], "category_id int, category_name string, slug string, x string"), "categories")
    assert df.columns == ["category_id", "category_name", "slug"]
    items = "order_id long, line_no int, product_id long, quantity int, unit_price double"
    assert conform(spark.createDataFrame([(1, 1, 1, 1, 2.5)], items), "order_items").schema["unit_price"].dataType.simpleString() == "decimal(10,2)"
    with pytest.raises(ValueError, match="price"):
        conform(spark.createDataFrame([(1, "a")], "product_id long, product_name string"), "products")
    with pytest.raises(ValueError, match="orders"):
        load_jdbc(spark, "jdbc:none", {})


def test_creation_time_keeps_its_hour(spark):
    from vitrina.sources.shop import SHOP_SCHEMA, conform

    row = spark.range(1).selectExpr(*(f"TIMESTAMP_NTZ'2024-01-02 03:04:05' AS {c}" if c == "created_at" else f"CAST(NULL AS {k}) AS {c}" for c, k in SHOP_SCHEMA["products"]))
    assert conform(row, "products").first().created_at.hour == 3
