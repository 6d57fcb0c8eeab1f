"""Search index, rank directories, bitmaps of customers and the bucketed cart store."""

from __future__ import annotations

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from tests.fixtures import D, make_tables, ts
from vitrina.operators import catalog, indexes
from vitrina.plans.registry import tables_for
from vitrina.streaming import cart_store, cart_sync

TERMS = ["Gear", "gear", "a%b", "a_b", "%", "_", "ab", "á", "Ánf", "z", "a\\b", "a\\%b", "c% d", "__", "ÁNFORA%x", "lo%lo", "no such", "xx", "İ", "日本", "é_e", "%%a", "  new  "]


def test_search_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(1)
    words = ["gear", "Gear", "a%b", "a_b", "axb", "ab", "Ánfora", "ánfora x", "zócalo", "a\\b", "c d", "lolo", "lo lo", "xx", "İstanbul", "日本語", "été", "new", "", "z"]
    text = lambda: rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 4)))])
    t = make_tables(spark, products=[{"product_id": k, "product_name": text(), "description": text(), "category_id": k % 3, "price": D(k), "is_active": k % 7 > 0, "stock": 1} for k in range(150)])
    path = str(tmp_path / "index")
    indexes.build_search_index(t, path, gram_buckets=64, product_buckets=64)
    for term in TERMS:
        want = sorted(map(str, catalog.search_products(t, term, show_all=True).collect()))
        assert sorted(map(str, indexes.search_indexed(t, path, term, show_all=True).collect())) == want, term
    assert [r.product_id for r in indexes.search_indexed(t, path, "e", page=2, limit=7).collect()] == [r.product_id for r in catalog.search_products(t, "e", page=2, limit=7).collect()]
    with pytest.raises(ValueError):
        indexes.search_indexed(t, path, "  ")


def test_search_reads_only_posted_folders(spark, tmp_path):
    t, path = tables_for(spark, SF0001), str(tmp_path / "index")
    indexes.build_search_index(t, path)
    found = indexes.search_candidates(spark, path, "gear")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "gram_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert len({f.split("gram_bucket=")[1].split("/")[0] for f in found.inputFiles() if "gram_bucket=" in f}) <= 64
    whole = indexes.search_indexed(t, path, "gear", show_all=True)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in whole


def test_literal_parts():
    assert indexes.literal_parts("%a\\%b_c%") == ["a%b", "c"]
    assert indexes.literal_parts("%%") == []


@pytest.mark.parametrize("sort", list(catalog.SORT_OPTIONS))
def test_every_page_of_a_directory(spark, tmp_path, sort):
    rng = random.Random(3)
    t = make_tables(
        spark,
        products=[
            {"product_id": k, "product_name": rng.choice([None, "a", "b", "É", "e"]), "category_id": 1, "price": rng.choice([None, D(1), D(2), D(k)]), "is_active": k % 5 > 0, "stock": k,
             "created_at": rng.choice([None, ts("2024-01-01"), ts("2024-02-01")])}
            for k in range(120)
        ],
    )
    path = str(tmp_path / "rank")
    indexes.build_catalog_directory(t, path, sort, ranges=9)
    for page in (1, 2, 7, 10, 11, 50):
        want = [r.product_id for r in catalog.catalog_page(t, sort=sort, page=page, limit=10).collect()]
        assert [r.product_id for r in indexes.catalog_deep_page(t, path, sort, page, 10).collect()] == want
    order = catalog.sort_columns(sort)
    deep = indexes.ranked_page(spark, path, order, 7, 10)
    assert len({f.split("_range=")[1].split("/")[0] for f in deep.inputFiles()}) <= 3  # not the ranges before
    with pytest.raises(ValueError):
        indexes.ranked_page(spark, path, order, 0, 10)


def test_bitmaps_of_customers(spark):
    rng = random.Random(5)
    ids = [None, -5, 0, 1, 32767, 32768, 10**12, *range(40)]
    orders = [{"order_id": k, "customer_id": rng.choice(ids), "status": rng.choice(["Cancelado", "Enviado"]), "order_date": ts(f"20{rng.choice([23, 24])}-{rng.randint(1, 12):02d}-03")} for k in range(900)]
    got = {(r.kind, r.start): r.customers for r in indexes.active_customers(make_tables(spark, orders=orders)).collect()}
    want = {}
    for o in orders:
        if o["status"] != "Cancelado" and o["customer_id"] is not None:
            at = o["order_date"].replace(day=1)
            for key in (("month", at), ("quarter", at.replace(month=(at.month - 1) // 3 * 3 + 1)), ("year", at.replace(month=1)), ("all", None)):
                want.setdefault(key, set()).add(o["customer_id"])
    assert got == {k: len(v) for k, v in want.items()}


def _folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_cart_store_follows_the_whole_table_sync(spark, tmp_path):
    rng = random.Random(8)
    products = [{"product_id": k, "product_name": "a", "category_id": 1, "price": D(1), "stock": rng.randint(0, 20), "is_active": k % 6 > 0} for k in range(20)]
    lines = [{"id": k, "customer_id": None if k % 5 == 0 else k % 60, "session_id": f"s{k}" if k % 5 == 0 or k % 11 == 0 else None, "product_id": k % 20, "quantity": 1 + k % 9, "size": "", "color": "", "updated_at": ts("2024-01-01")} for k in range(1200)]
    t = make_tables(spark, products=products, cart_items=lines)
    root, plain = str(tmp_path / "store"), str(tmp_path / "plain")
    cart_store.create(t.cart_items, root, buckets=32)
    table = lambda version=None: sorted(map(str, cart_store.read(spark, root, t.cart_items.schema, version).collect()))
    assert table() == sorted(map(str, t.cart_items.collect()))
    base = _folder_bytes(f"{root}/data/v=-1")
    batches = [[(rng.choice([1, 2, 700 + n]), rng.randrange(22), "", "", rng.choice([None, 0, 2, 5])) for _ in range(6)] for n in range(4)]
    for n, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, cart_sync.REQUEST_SCHEMA)
        cart_sync.apply_batch(spark, t, frame, n, plain)
        written = cart_store.apply_batch(t, frame, n, root, buckets=32)
        assert len(written) <= 4 and _folder_bytes(f"{root}/data/v={n}") < base  # a few of 33 buckets
        assert table() == sorted(map(str, spark.read.schema(t.cart_items.schema).parquet(f"{plain}/carts/v={n}").collect()))
        assert sorted(map(str, spark.read.parquet(f"{root}/results/batch_id={n}").collect())) == sorted(map(str, spark.read.parquet(f"{plain}/results/batch_id={n}").collect()))
    last = table()
    cart_store.apply_batch(t, spark.createDataFrame(batches[3], cart_sync.REQUEST_SCHEMA), 3, root, buckets=32)  # replayed
    assert table() == last
    cart_store.compact(spark, root, t.cart_items.schema, buckets=32)
    assert table() == last and len(set(cart_store.manifest(spark, root, 3).values())) == 1
    cart_store.apply_batch(t, spark.createDataFrame(batches[3], cart_sync.REQUEST_SCHEMA), 3, root, buckets=32)  # replayed once more
    assert table() == last
    cart_store.remove_unused(spark, root)
    assert cart_store.versions(spark, root) == [2, 3] and table() == last and len(table(2)) > 0


def test_a_batch_without_manifest_changes_nothing(spark, tmp_path):
    t = make_tables(spark, products=[{"product_id": 1, "product_name": "a", "category_id": 1, "price": D(1), "stock": 9, "is_active": True}], cart_items=[{"id": 1, "customer_id": 7, "product_id": 1, "quantity": 2, "size": "", "color": ""}])
    root = str(tmp_path / "store")
    with pytest.raises(ValueError):
        cart_store.apply_batch(t, spark.createDataFrame([], cart_sync.REQUEST_SCHEMA), 0, root)
    cart_store.create(t.cart_items, root, buckets=4)
    t.cart_items.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/data/v=5")  # died before its manifest
    assert [r.quantity for r in cart_store.read(spark, root, t.cart_items.schema).collect()] == [2]


def test_store_stream_replays_a_batch_without_commit_record(spark, tmp_path):
    t = make_tables(spark, products=[{"product_id": k, "product_name": "a", "category_id": 1, "price": D(1), "stock": 20, "is_active": True} for k in (1, 2)], cart_items=[{"id": 10, "customer_id": 7, "product_id": 1, "quantity": 2, "size": "", "color": ""}])
    root, requests, ckpt = str(tmp_path / "store"), str(tmp_path / "requests"), str(tmp_path / "ckpt")
    cart_store.create(t.cart_items, root, buckets=8)
    run = lambda: cart_store.start_store_sync(t, requests + "/*", root, buckets=8, checkpoint=ckpt).awaitTermination(120)
    table = lambda: sorted((r.product_id, r.quantity) for r in cart_store.read(spark, root, t.cart_items.schema).collect())
    spark.createDataFrame([(7, 1, "", "", 4)], cart_sync.REQUEST_SCHEMA).write.parquet(requests + "/f1")
    run()
    assert table() == [(1, 6)]
    shutil.rmtree(ckpt + "/commits")
    run()
    assert table() == [(1, 6)]
    spark.createDataFrame([(7, 2, "", "", 1), (8, 1, "", "", 3)], cart_sync.REQUEST_SCHEMA).write.parquet(requests + "/f2")
    run()
    assert table() == [(1, 3), (1, 6), (2, 1)] and cart_store.versions(spark, root) == [-1, 0, 1]
