"""Spark result vs DuckDB oracle, the way the driver compares them.

Row count, column names, exact column types, and an order-insensitive
multiset of exact value tuples (columns sorted by name). Usable from pytest and
as a CLI: ``python -m tests.compare [sf_dir] [key ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from vitrina.sources.tables import SOURCE_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        # exact: money is rounded to cents as DOUBLE in both engines
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _kind(type_name: str) -> str:
    t = type_name.lower()
    if any(k in t for k in ("array", "list", "[]")):
        return "list"
    if "struct" in t:
        return "struct"
    if t.startswith("timestamp"):
        return "timestamp"
    if t == "date" or t == "datetype()":
        return "date"
    if any(k in t for k in ("bigint", "long", "int", "short", "byte", "hugeint")):
        return "int"
    if any(k in t for k in ("double", "float", "decimal", "real")):
        return "float"
    if "bool" in t:
        return "bool"
    return "str"


# Spark simple type -> DuckDB type name, for the exact type check.
EXACT = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_exact = {f.name: EXACT.get(f.dataType.simpleString()) for f in spark_df.schema.fields}
    s_types = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    s_rows = [tuple(_norm(x) for x in r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    d_exact = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    bad_types = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
    bad_types.update({c: (s_exact[c], d_exact[c]) for c in s_cols if s_exact[c] and s_exact[c] != d_exact[c]})
    if bad_types:
        return False, f"types differ: {bad_types}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_set = sorted((tuple(r[i] for i in order) for r in s_rows), key=repr)
    d_set = sorted((tuple(r[d_index[s_cols[i]]] for i in order) for r in d_rows), key=repr)
    if s_set != d_set:
        diff_s = [r for r in s_set if r not in set(d_set)][:3]
        diff_d = [r for r in d_set if r not in set(s_set)][:3]
        return False, f"values differ; cols={[s_cols[i] for i in order]} spark-only={diff_s} duck-only={diff_d}"
    return True, f"{len(s_rows)} rows"


def main(argv: list[str]) -> int:
    from vitrina.plans.registry import oracle_sql, queries
    from vitrina.session import local_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("/")]
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    failures = 0
    for key in keys or list(qs):
        t0 = time.time()
        df = qs[key](spark, sf_dir)
        if key not in os_:
            n = df.count()
            print(f"{key:32s} ROWS-ONLY {n} rows ({time.time() - t0:.1f}s)")
            continue
        try:
            ok, msg = compare(df, con, os_[key])
        except Exception as exc:  # report and keep going
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:400]}"
        failures += not ok
        print(f"{key:32s} {'OK ' if ok else 'BAD'} {msg} ({time.time() - t0:.1f}s)", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
