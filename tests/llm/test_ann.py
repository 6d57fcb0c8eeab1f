from __future__ import annotations

import numpy as np

from tests.llm.conftest import SF0001
from vitrina.llm import ann


def exact(vectors, own, k=5):
    q = np.array(vectors[own], float)
    scored = []
    for i, v in vectors.items():
        if i != own:
            x = np.array(v, float)
            scored.append((-round(float((q * x).sum() / np.sqrt((q * q).sum()) / np.sqrt((x * x).sum())), 12), i))
    return sorted(scored)[:k]


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")


def search(df, **options):
    return by_query(ann.nearest(df, pivots=32, length=16, **options))


def test_recall_in_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(1500)}
    for block, queries in ((20_000, 2_000), (400, 7)):
        got = search(table(spark, vectors.items()), block=block, query_block=queries, least=150, share=0.2)
        hits = sum(len({i for _, i in got[q]} & {i for _, i in exact(vectors, q)}) for q in got)
        assert len(got) == 30 and hits >= 0.9 * 150


def test_all_rows_scored_is_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(120)}
    vectors |= {i: vectors[3] for i in range(200, 260)}  # copies: the smallest ids win
    got = search(table(spark, vectors.items()), least=10_000)
    assert got == {q: exact(vectors, q) for q in (0, 50, 100, 200, 250)}


def test_repeated_rows_leave_other_ids_in(spark):
    rng = np.random.default_rng(3)
    v, w = (rng.normal(size=8).astype(np.float32).tolist() for _ in range(2))
    rows = [(50, v)] * 20 + [(i, v) for i in range(51, 56)] + [(60, w)] * 9 + [(100, w), (61, w), (61, w)]
    got = search(table(spark, rows))
    assert [i for _, i in got[50]] == [51, 52, 53, 54, 55] and {s for s, _ in got[50]} == {-1.0}
    assert [i for _, i in got[100]] == [60] * 5
    rows = [(i, v) for i in (50, 51, 51, 52) for _ in range(2)]
    assert [i for _, i in search(table(spark, rows))[50]] == [51, 51, 51, 51, 52]


def test_unusable_vectors_and_small_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (50, [None, 1.0])]
    got = search(table(spark, rows))
    assert list(got) == [0] and [i for _, i in got[0]] == [7]
    assert search(table(spark, rows[:1])) == {}
    assert ann.nearest(table(spark, rows).where("false")).count() == 0


def test_query(spark):
    got = by_query(ann.op9_nearest(spark, SF0001))
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()}
    asked = [i for i in vectors if i % 50 == 0]
    assert sorted(got) == asked
    assert sum(len({i for _, i in got[q]} & {i for _, i in exact(vectors, q)}) for q in asked) >= 0.9 * 5 * len(asked)
