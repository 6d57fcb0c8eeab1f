from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from vitrina.llm import mixing


def brute(rows):
    """rows (id, source, size) -> {(id, source, size): taken}, targets; by the plain rounds of the rule."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 3 * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3 * sizes[s] for s in above)
        open_ -= above
    taken = []
    for s in order:
        own = [(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{n}".encode()).hexdigest(), -1 if i is None else i, n) for i, t, n in rows if t == s]
        budget, before = int(target[s] + 0.5), 0
        for _, i, n in sorted(own):
            rest = budget % sizes[s] if sizes[s] else 0
            part = min(max(rest - before, 0), n)
            taken.append((i, s, n, (budget // sizes[s] if sizes[s] else 0) * n + part))
            before += n
    return sorted(taken, key=str), target


def frame_of(spark, rows):
    data = [(i, s, None if n is None else " ".join(["w"] * n), n) for i, s, n in rows]
    return spark.createDataFrame(data, "doc_id long, source string, text string, size long").withColumn("key", F.lit("clash"))


def test_against_the_rounds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "ä", "c", "d", None] + ["hot"] * 6), rng.randrange(1, 40)) for i in range(300)]
    rows += [(900, "tiny", 2), (901, "none", 0), (None, "a", 5), (902, "a", 0)]
    got = mixing.mix(frame_of(spark, rows)).collect()
    want, target = brute(rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.source, r.size, r.taken) for r in got), key=str) == want
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in got)
    assert all(r.taken <= 3 * r.size for r in got)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a", None), (2, None, 3), (2, None, 3), (None, None, 4)]
    got = mixing.mix(frame_of(spark, rows)).collect()
    assert len(got) == 4 and sum(r.taken for r in got if r.source is None) == 10
    assert mixing.mix(frame_of(spark, [(1, "a", None)])).first().taken == 0
    assert mixing.mix(frame_of(spark, rows).where("false")).count() == 0


def test_documents_follow_the_mix(spark):
    rows = [(i, "abc"[i % 3], 5 + i) for i in range(30)]
    docs = frame_of(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r.doc_id: r.w for r in mixed.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("w")).collect()}
    assert words == {r.doc_id: r.taken for r in mixing.mix(docs).where("taken > 0").collect()}
