"""Hand-written micro-fixtures: shop tables built from a few literal rows.

``make_tables(spark, orders=[{...}], ...)`` returns ``Tables`` whose frames
have the mapped schemas (taken from the loader, all columns nullable); any
table not given is empty. Missing fields in a row are NULL.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from vitrina.sources.tables import Tables, load

_SCHEMAS: dict[str, T.StructType] = {}


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def schemas(spark) -> dict[str, T.StructType]:
    if not _SCHEMAS:
        base = load(spark, "/root/testdata/sf0.001")
        for name in base.names():
            _SCHEMAS[name] = _nullable(getattr(base, name).schema)
    return _SCHEMAS


def make_tables(spark, **rows_by_table) -> Tables:
    sch = schemas(spark)
    frames = {}
    for name, schema in sch.items():
        rows = rows_by_table.get(name, [])
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        frames[name] = spark.createDataFrame(data, schema)
    return Tables(**frames)


def D(x) -> Decimal:
    return Decimal(str(x))


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)
