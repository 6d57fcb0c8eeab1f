from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.llm import fingerprint as fp


def vectors(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r.v for r in df.select("k", fp.vector(F.coalesce("t", F.lit(""))).alias("v")).orderBy("k").collect()]


def test_order_does_not_matter_and_content_does(spark):
    a, b, c, d, e = vectors(spark, "One two.\nThree.\nFour.\n", "Four.\nThree.\nOne two.\n", "Four.\nThree.\nOne two\n", "", "\n")
    assert a == b and a != c and d != e and len(a) == fp.EXACT + 1 + fp.LANES


def test_insert_and_delete(spark):
    rows = spark.createDataFrame([("A. B.\n", "C!\nD? é.")], "x string, y string")
    v = rows.select(fp.vector(F.col("x")).alias("x"), fp.vector(F.col("y")).alias("y"), fp.vector(F.concat("x", "y")).alias("xy"))
    r = v.select("x", "xy", fp.plus(F.col("x"), F.col("y")).alias("p"), fp.minus(F.col("xy"), F.col("y")).alias("m")).first()
    assert r.p == r.xy and r.m == r.x


def test_likeness(spark):
    a = "".join(f"Sentence number {k} of the first text.\n" for k in range(200))
    b = "".join(f"Another line {k} that stands elsewhere.\n" for k in range(200))
    df = spark.createDataFrame([(a, a[: len(a) // 2] + b[: len(b) // 2], b)], "a string, h string, b string")
    v = df.select(*(fp.vector(F.col(c)).alias(c) for c in df.columns))
    r = v.select(fp.likeness(F.col("a"), F.col("a")), fp.likeness(F.col("a"), F.col("h")), fp.likeness(F.col("a"), F.col("b"))).first()
    assert r[0] == 1 and 0.25 < r[1] < 0.75 and r[2] < 0.3


def test_next_row(spark, frame, awkward, empty):
    rows = [(5, "e"), (1, "a"), (1, "b"), (None, "n"), (9, None), (7, "g")] + [(100 + 3 * k, str(k)) for k in range(50)]
    for per_group in (1, 7, 1000):
        got = fp.with_next(frame(rows), rows_per_group=per_group).collect()
        order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
        texts = [t or "" for _, t in order]
        assert sorted((r.text, r.next_text) for r in got) == sorted(zip(texts, texts[1:] + texts[:1]))
    assert fp.with_next(frame([(1, "only")])).first().next_text == "only"
    assert fp.with_next(empty).count() == 0
    assert fp.with_next(frame(awkward)).count() == len(awkward)
