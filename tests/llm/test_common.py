from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitrina.llm.common import components, running_totals


def test_running_totals(spark):
    rng = random.Random(6)
    arrays = [[], [3], [rng.randrange(9) for _ in range(5)], [rng.randrange(9) for _ in range(1000)]]
    df = spark.createDataFrame([(x,) for x in arrays], "x array<bigint>")
    for xs, r in zip(arrays, df.select(running_totals(F.col("x")).alias("t")).collect()):
        assert r.t == [sum(xs[:k]) for k in range(len(xs))]


@pytest.mark.parametrize("edges_a_task", [0, 5, 1000])
def test_components(spark, edges_a_task):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + rng.randrange(1, 60)) for _ in range(80)] + [(500, 501), (501, 502), (502, 500), (7, 7), (900, 900), (-3, 10)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), edges_a_task).collect()}
    assert got == {k: v for k, v in label.items() if k != 900}
    assert components(spark.createDataFrame(edges, "a long, b long").where("false"), edges_a_task).count() == 0
