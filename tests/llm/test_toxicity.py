from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vitrina.llm import toxicity as tox


def plain_segments(scores):
    """All maximal scoring segments by definition: the best segment, then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (a, b + 1, total)
    if not best:
        return []
    a, b, s = best
    return plain_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in plain_segments(scores[b:])]


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        hits = [(at, round(rng.uniform(0.1, 3), 3)) for at in range(40) if rng.random() < 0.3]
        scores = [-tox.DRIFT] * 40
        for at, x in hits:
            scores[at] = x
        got = [(a, b, round(s, 6)) for a, b, s in tox.maximal_segments(hits)]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores)]


def corpus(n=400):
    rng = random.Random(5)
    plain = [f"word{k}" for k in range(200)]
    rows, marks = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(80)]
        if i % 4 == 0:
            at = rng.randrange(60)
            text[at : at + 6] = [rng.choice(["vile", "nasty", "rotten", "foulish"]) for _ in range(6)]
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(i % 4 == 0)))
    return rows, marks


def test_held_out_accuracy_and_passages(spark, frame):
    rows, marks = corpus()
    model = tox.train(frame(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    scored = {r.doc_id: r for r in tox.score(frame(rows), model).collect()}
    held = [i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    right = sum((scored[i].score >= tox.THRESHOLD) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    spans = scored[0].passages
    assert spans and all("word" not in " ".join(rows[0][1].split()[p.start : p.end]) or p.score > 0 for p in spans)


def test_odd_rows(spark, frame, awkward, empty):
    rows, marks = corpus(80)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")
    model = tox.train(frame(rows), labels)
    got = tox.score(frame(awkward), model).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    assert tox.score(empty, model).count() == 0
    none = tox.train(frame(rows), labels.where("false"))
    assert all(r.score < 1e-6 for r in tox.score(frame(rows), none).collect())
    assert not tox.train(empty, labels).weights


def plain_model(rows, marks):
    """Everything anew from texts and labels: counts, log-odds, segments, laws and the curve, in plain Python."""
    texts = dict(rows)
    label = {i: t for i, _, t in marks if zlib.crc32(str(i).encode()) % 4 != 2}
    docs = [([w.strip(tox._EDGES) for w in texts[i].lower().encode().split()], y) for i, y in label.items()]
    keys = lambda ws: set(ws) | {s for w in set(ws) for s in tox.stems(w)}
    count = {y: Counter(k for ws, l in docs if l == y for k in keys(ws)) for y in (0, 1)}
    n = {y: sum(x for k, x in count[y].items() if not k.startswith(b"\0")) for y in (0, 1)}
    size = min(n.values())

    def odds(t, c):
        prior = size * (t + c) / (n[0] + n[1])
        a, b = t + prior, c + prior
        delta = math.log(a / (n[1] + size - a)) - math.log(b / (n[0] + size - b))
        return delta, delta / math.sqrt(1 / a + 1 / b)

    seen = [k for k in set(count[0]) | set(count[1]) if count[0][k] + count[1][k] >= tox.MIN_COUNT]
    weights = {k: odds(count[1][k], count[0][k])[0] - tox.DRIFT for k in seen if (z := odds(count[1][k], count[0][k])[1]) >= tox.MIN_Z or z <= -tox.MIN_Z_CLEAN}

    def lean_of(k, own=None):
        t, c = count[1][k] - (own == 1), count[0][k] - (own == 0)
        if k not in seen or k.startswith(b"\0") or min(t, c) < 0 or t + c < tox.MIN_COUNT - 1:
            return 0.0
        delta, z = odds(t, c)
        return delta if abs(z) >= tox.FAINT_Z else 0.0

    clean = {k: count[0][k] for k in weights}
    rate = tox.extreme_value_rate(weights, clean, n[0])

    def segments(ws):
        scores, previous = [], None
        for w in ws:
            x = next((weights[k] for k in (w, *tox.stems(w)) if k in weights), None)
            scores.append(-tox.DRIFT if x is None else x if w != previous else 0.0)
            previous = w if x is not None else previous
        return plain_segments(scores)

    tops = [(max(s for _, _, s in found), len(ws)) for ws, y in docs if y == 0 and (found := segments(ws))]
    ln_k = sum(rate * s - math.log(m) for s, m in tops) / len(tops) - np.euler_gamma if tops else 0.0

    def features(ws, own=None):
        e = [rate * s - ln_k - math.log(len(ws)) for _, _, s in segments(ws)]
        evidence = sum(x for x in e if x > -math.log(tox.MAX_E))
        lean = sum(lean_of(w, own) for w in ws) / (len(ws) + tox.LEAN_WORDS)
        return [math.log1p(evidence), min(0.0, max(-tox.FAINT, max(e, default=-tox.FAINT))) / tox.FAINT, lean]

    return weights, features, [(features(ws, y), y) for ws, y in docs]


def test_scores_from_texts_and_labels(spark, frame):
    """Weights, features, and a curve at the optimum of its own objective, against a plain recomputation."""
    rows, marks = corpus(160)
    rng = random.Random(6)
    rows = [(i, t if i % 4 == 0 else t + " benign" * (rng.random() < 0.8)) for i, t in rows]
    model = tox.train(frame(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    weights, features, fitted = plain_model(rows, marks)
    assert model.weights == pytest.approx(weights) and min(weights.values()) < -tox.DRIFT < 0 < max(weights.values())
    got = {r.doc_id: r for r in tox.score(frame(rows), model).collect()}
    for i, text in rows:
        x = features([w.strip(tox._EDGES) for w in text.lower().encode().split()])
        assert tox.design((got[i].evidence, got[i].nearness, got[i].lean)) == pytest.approx(x, abs=1e-9)
        z = sum(a * b for a, b in zip(model.slopes, x)) + model.bias
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    w = np.array([*model.slopes, model.bias])
    columns = np.array([[*x, 1] for x, _ in fitted])
    y = np.array([t for _, t in fitted])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    slope = columns.T @ (1 / (1 + np.exp(-columns @ w)) - target) + tox.DECAY * w
    assert np.abs(slope).max() < 1e-4


def test_segments_with_weights_of_both_signs():
    rng = random.Random(12)
    for _ in range(200):
        hits = [(at, round(rng.uniform(-2, 3), 3)) for at in range(40) if rng.random() < 0.5]
        scores = [-tox.DRIFT] * 40
        for at, x in hits:
            scores[at] = x
        assert [(a, b, round(s, 6)) for a, b, s in tox.maximal_segments(hits)] == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores)]


def test_query_grades_most_documents(spark):
    scores = [r.score for r in tox.op5_toxicity(spark, "/root/testdata/sf0.01").collect()]
    assert max(Counter(scores).values()) < len(scores) / 2
