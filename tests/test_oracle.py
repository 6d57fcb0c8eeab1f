"""The correctness gate: every registered query against its DuckDB oracle at sf0.01."""

from __future__ import annotations

import pytest

from tests.compare import compare
from tests.conftest import SF001
from vitrina.plans.registry import oracle_sql, queries

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck_sf001, key):
    ok, msg = compare(QUERIES[key](spark, SF001), duck_sf001, ORACLES[key])
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["category_id", "category_name", "total_orders", "units_sold", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
