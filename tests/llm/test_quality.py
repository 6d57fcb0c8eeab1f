from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SF0001
from vitrina.llm import quality


def corpus(n=600):
    rng = random.Random(8)
    plain = [f"{a}{b}{c}" for a in ("re", "con", "ta", "mu") for b in ("li", "sta", "po") for c in ("n", "ring", "ve", "t")]
    rows, marks = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randrange(40, 120))]
        bad = i % 5 == 0
        if bad:
            text = [w.upper() + "!!" for w in text] if i % 2 else [w + rng.choice(["###", "%%%", " |"]) for w in text]
        rows.append((i, " ".join(text)))
        marks.append((i, int(not bad), 0))
    return rows, marks


def test_held_out_accuracy(spark, frame):
    rows, marks = corpus(1500)
    model = quality.train(frame(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert 0.7 <= model.prior <= 0.9
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(r.score >= quality.THRESHOLD) == (r.doc_id % 5 != 0) for r in quality.score(frame(rows), model).collect() if r.doc_id in held]
    assert np.mean(right) >= 0.95
    kept = quality.keep_good(frame(rows), model)
    assert kept.columns == frame(rows).columns
    assert kept.where("doc_id % 5 <> 0").count() >= 0.98 * 1200


def test_labels_zero_are_not_used(spark, frame):
    rows, marks = corpus(200)
    one = quality.train(frame(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    two = quality.train(frame(rows), spark.createDataFrame([m for m in marks if m[1]], "doc_id long, quality int, toxic int"))
    assert one.prior == two.prior and np.array_equal(one.weights, two.weights)


def test_odd_rows(spark, frame, awkward, empty):
    rows, marks = corpus(200)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (7777, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(frame(rows), labels)
    got = quality.score(frame(awkward), model).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    for untrained in (quality.train(empty, labels), quality.train(frame(rows), labels.where("false"))):
        assert all(r.score == pytest.approx(0.5) for r in quality.score(frame(rows[:3]), untrained).collect())


def plain_statistics(text):
    """The statistics of a text, one by one."""
    raw = (text or "").encode()
    ws = raw.split()
    if not raw:
        return [0.0] * quality.N_FEATURES
    marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    shares = [0, 0, 0, 0, 0, 0, 0, *[0] * len(marks)]
    for b in raw:
        c = chr(b)
        k = 7 + marks.index(b) if b in marks else 6 if b >= 128 else 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c in " \t\r\v\f" else 5 if c == "\n" else 0
        shares[k] += 1
    shares = [x / len(raw) for x in shares]
    if not ws:
        return [*shares, *[0.0] * 12]
    n, lengths, lines = len(ws), [len(w) for w in ws], raw.split(b"\n")
    return [
        *shares, np.log(n + 1), np.mean(lengths), np.std(lengths), max(lengths), sum(x <= 2 for x in lengths) / n, len(set(ws)) / n, len(set(ws)) / n**0.8,
        max(ws.count(w) for w in set(ws)) / n, sum(a == b for a, b in zip(ws, ws[1:])) / n, len(set(lines)) / len(lines), n / len(lines),
        len({tuple(ws[k : k + 3]) for k in range(n - 2)}) / max(1, n - 2),
    ]


def plain_scores(x, positive, unlabelled):
    """Scores of all rows by a refit on dense indicator matrices."""
    both = np.concatenate([x[positive], x[unlabelled]])
    edges = []
    for column in both.T:
        above = column[column > 0]
        some = len(above) and len(above) <= 0.9 * len(column)
        edges.append(np.r_[0.0, np.quantile(above, np.linspace(0, 1, 10)[1:-1])] if some else np.quantile(column, np.linspace(0, 1, 11)[1:-1]))
    cells = np.zeros((len(x), x.shape[1] * 10 + 1))
    for k, e in enumerate(edges):
        for r, v in enumerate(x[:, k]):
            cells[r, 10 * k + int((e < v).sum())] = 1
    cells[:, -1] = 1
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def descend(gradient):
        w = m = v = np.zeros(cells.shape[1])
        for t in range(1, quality.STEPS + 1):
            g = gradient(w) + quality.DECAY * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w

    p, u = cells[positive], cells[unlabelled]
    rng = np.random.default_rng(0)
    hp, hu = np.array_split(rng.permutation(len(p)), 2), np.array_split(rng.permutation(len(u)), 2)
    ratios = []
    for a, b in ((0, 1), (1, 0)):
        w = descend(lambda w: p[hp[a]].T @ (sig(p[hp[a]] @ w) - 1) / len(hp[a]) + u[hu[a]].T @ sig(u[hu[a]] @ w) / len(hu[a]))  # noqa: B023
        zp, zu = p[hp[b]] @ w, u[hu[b]] @ w
        ratios.append(min((zu >= s).mean() / max((zp >= s).mean(), 1e-9) for s in np.quantile(zp, np.linspace(0, 0.5, 51))))
    prior = float(np.clip(np.mean(ratios), 0.05, 0.98))

    def gradient(w):
        zp, zu = p @ w, u @ w
        negative = np.log1p(np.exp(np.clip(zu, -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(zp, -30, 30))).mean()
        of_negative = u.T @ sig(zu) / len(u) - prior * p.T @ sig(zp) / len(p)
        return -of_negative if negative < 0 else prior * p.T @ (sig(zp) - 1) / len(p) + of_negative

    w = descend(gradient)
    zp, zu, z = p @ w, u @ w, cells @ w
    return prior, z, zp, zu


def test_model_and_scores_against_a_plain_refit(spark, documents):
    """Statistics, prior, weights and the query's scores on the whole small table (all of it is within the samples' bounds)."""
    rows = documents.collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    x = np.array([plain_statistics(r.text) for r in rows])
    assert np.allclose(np.array([quality.statistics(r.text) for r in rows]), x, rtol=1e-5, atol=1e-6)
    x = np.array([quality.statistics(r.text) for r in rows], np.float32)
    model = quality.train(documents, spark.read.parquet(f"{SF0001}/labels.parquet"))
    trusted = [k for k, r in enumerate(rows) if marks.get(r.doc_id) == 1 and zlib.crc32(str(r.doc_id).encode()) % 5 > 0]
    # the fit takes rows in the order Spark collects them; halves of the prior estimate go by that order
    got = quality.fit(x[trusted], x)
    prior, z, zp, zu = plain_scores(x, trusted, list(range(len(rows))))
    assert got.prior == pytest.approx(prior, abs=1e-6)
    own = got.weights[np.arange(len(got.edges)), quality._bins(x, got.edges)].sum(1) + got.bias
    assert np.allclose(own, z, atol=1e-4)
    # scores: the share of positives by cell of the logit, pooled until it rises
    cuts = np.unique(np.quantile(zu, np.linspace(0, 1, 61)[1:-1]))
    of = lambda v: np.array([(np.searchsorted(cuts, v, side="right") == k).sum() for k in range(len(cuts) + 1)])
    a, b = prior * of(zp) / len(zp), np.maximum(of(zu) / len(zu), 1e-9)
    mean = lambda i, j: a[i : j + 1].sum() / b[i : j + 1].sum()
    rising = [max(min(mean(i, j) for j in range(k, len(a))) for i in range(k + 1)) for k in range(len(a))]  # the least-squares rising sequence
    assert np.allclose(got.share, np.minimum(rising, 1), atol=1e-6)
    query = {r.doc_id: r.score for r in quality.op10_quality(spark, SF0001).collect()}
    assert np.allclose([query[r.doc_id] for r in rows], model.scores(x), atol=1e-9)
    assert np.mean([(model.scores(x)[k] >= 0.3) == (got.scores(x)[k] >= 0.3) for k in range(len(rows))]) > 0.98
