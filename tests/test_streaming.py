from __future__ import annotations

import os
import shutil

import pytest

from tests.fixtures import D, make_tables
from vitrina.streaming.cart_sync import REQUEST_SCHEMA, apply_batch, remove_old_snapshots, snapshot_versions, start_cart_sync


def test_cart_sync_stream_applies_batches_in_order(spark, tmp_path):
    t = make_tables(
        spark,
        products=[
            {"product_id": 1, "product_name": "a", "category_id": 1, "price": D("1.00"), "stock": 20, "is_active": True},
            {"product_id": 2, "product_name": "b", "category_id": 1, "price": D("1.00"), "stock": 3, "is_active": True},
        ],
        cart_items=[{"id": 10, "customer_id": 7, "product_id": 1, "quantity": 2, "size": "", "color": ""}],
    )
    req = str(tmp_path / "requests")
    out = str(tmp_path / "out")
    spark.createDataFrame([(7, 1, "", "", 4), (7, 2, "", "", 2)], REQUEST_SCHEMA).write.parquet(req + "/f1")
    q = start_cart_sync(spark, t, req + "/*", out, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    first = {r.product_id: r.quantity for r in spark.read.parquet(out + "/carts/v=0").collect()}
    assert first == {1: 6, 2: 2}
    spark.createDataFrame([(7, 2, "", "", 2)], REQUEST_SCHEMA).write.parquet(req + "/f2")
    q = start_cart_sync(spark, t, req + "/*", out, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    second = {r.product_id: r.quantity for r in spark.read.parquet(out + "/carts/v=1").collect()}
    assert second == {1: 6, 2: 3}  # the line inserted by batch 0 is updated, capped by stock
    assert sorted(os.listdir(out + "/results")) == ["batch_id=0", "batch_id=1"]


def _shop(spark):
    return make_tables(
        spark,
        products=[{"product_id": k, "product_name": "a", "category_id": 1, "price": D("1.00"), "stock": 20, "is_active": True} for k in (1, 2)],
        cart_items=[{"id": 10, "customer_id": 7, "product_id": 1, "quantity": 2, "size": "", "color": ""}],
    )


def _files(spark, out, batch_id):
    cart = sorted(map(str, spark.read.parquet(f"{out}/carts/v={batch_id}").collect()))
    return cart, sorted(map(str, spark.read.parquet(f"{out}/results/batch_id={batch_id}").collect()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t, out = _shop(spark), str(tmp_path / "out")
    one = spark.createDataFrame([(7, 1, "", "", 4), (7, 2, "", "", 2)], REQUEST_SCHEMA)
    two = spark.createDataFrame([(7, 2, "", "", 3)], REQUEST_SCHEMA)
    apply_batch(spark, t, one, 0, out)
    first = _files(spark, out, 0)
    apply_batch(spark, t, one, 0, out)  # committed files, but the commit was not recorded
    assert _files(spark, out, 0) == first
    apply_batch(spark, t, two, 1, out)
    second = _files(spark, out, 1)
    apply_batch(spark, t, two, 1, out)
    assert _files(spark, out, 1) == second and _files(spark, out, 0) == first
    apply_batch(spark, t, two, 2, out)
    assert remove_old_snapshots(spark, out) == [0] and snapshot_versions(spark, f"{out}/carts") == [1, 2]
    third = _files(spark, out, 2)
    apply_batch(spark, t, two, 2, out)
    assert _files(spark, out, 2) == third


def test_stream_replays_a_batch_without_commit_record(spark, tmp_path):
    t, out, req, ckpt = _shop(spark), str(tmp_path / "out"), str(tmp_path / "req"), str(tmp_path / "ckpt")
    spark.createDataFrame([(7, 1, "", "", 4)], REQUEST_SCHEMA).write.parquet(req + "/f1")
    start_cart_sync(spark, t, req + "/*", out, checkpoint=ckpt).awaitTermination(120)
    before = _files(spark, out, 0)
    shutil.rmtree(ckpt + "/commits")
    start_cart_sync(spark, t, req + "/*", out, checkpoint=ckpt).awaitTermination(120)
    assert _files(spark, out, 0) == before
    # another session with the same checkpoint goes on with the next batch
    spark.createDataFrame([(7, 1, "", "", 1)], REQUEST_SCHEMA).write.parquet(req + "/f2")
    start_cart_sync(spark.newSession(), t, req + "/*", out, checkpoint=ckpt).awaitTermination(120)
    assert [r.quantity for r in spark.read.parquet(f"{out}/carts/v=1").collect()] == [7]


def test_checkpoint_folder_is_required(spark, monkeypatch):
    from vitrina import session

    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            session.checkpoint_dir(spark)
