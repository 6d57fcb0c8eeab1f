"""Toxic passages by maximum-scoring segment search.

A word's log-odds are those of standing in a toxic rather than a clean document
(counted once a document), shrunk by a Dirichlet prior proportional to the word's
share of all training words. The scan takes them if they are significant: ``MIN_Z``
standard deviations above 0, or ``MIN_Z_CLEAN`` below. Words that have none of their
own take those of their first ``STEMS`` characters. Every word costs ``DRIFT``, so a word's
weight is its log-odds less that; it counts 0 if the weighted word before it is the
same. The Ruzzo-Tompa scan finds all maximal-scoring segments of a text in linear
time. For clean text the best score of n words follows an extreme-value law with
E = K n exp(-lambda s); lambda solves the moment equation for clean words and K is
fitted to clean training documents. Segments with E below ``MAX_E`` are the toxic
passages.

A document has three features: its evidence, the sum of -ln E over the passages; how
near its best segment comes to one (-ln E, from -``FAINT`` to 0); and its lean, the
mean of its words' log-odds (those at least ``FAINT_Z`` standard deviations from 0). A logistic curve over them, fitted to the training labels,
gives the score, so documents without a passage are graded as well.

Fitting uses at most ``max_toxic`` toxic and ``max_clean`` clean labelled
documents (the first by a hash of the id), checkpointed once. Word counts are
aggregated by Spark; the driver gets the significant words only, which that bound
limits. All documents are scored whole, in tasks, without a shuffle.

Defined cases: a null or empty text has no passage, no segment and lean 0; a very
long text is scanned whole in linear time and space; of equal segments the first
stands; rows with null ids or labels are not learnt from; repeated rows repeat;
without toxic labels no word has weight and the score is 0 for every row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fold, read_table, sampled_ids, texts_of, words

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MAX_TOXIC, MAX_CLEAN = 6_000, 12_000
MIN_Z, MIN_Z_CLEAN, FAINT_Z = 3.5, 2.0, 1.5
MIN_COUNT = 3
DRIFT = 0.5
MAX_E = 0.5
STEMS = (7, 5)
#: The least that the best segment's -ln E counts, and words added to a text's length in its lean.
FAINT, LEAN_WORDS = 12.0, 20
DECAY = 1e-3
_EDGES = bytes(b for b in range(33, 128) if not chr(b).isalnum())


def token(word: bytes) -> bytes:
    """A word without ASCII punctuation at its ends."""
    return word.strip(_EDGES)


def stems(tok: bytes) -> list[bytes]:
    """Keys of a word's first characters, longest first; words of no more characters have none."""
    text = tok.decode("utf-8", "ignore")
    return [b"\0" + text[:n].encode() for n in STEMS if len(text) > n]


@dataclass
class Model:
    """Weights of words and stems, and the laws that turn segment scores into a score."""

    weights: dict[bytes, float]
    leans: dict[bytes, float]
    rate: float = 1.0
    ln_k: float = 0.0
    slopes: tuple[float, float, float] = (0.0, 0.0, 0.0)
    bias: float = -30.0

    def weight(self, word: bytes) -> tuple[float, float]:
        """(weight in the scan, part of the lean) of a word."""
        tok = token(word)
        x = self.weights.get(tok)
        if x is None:
            x = next((x for s in stems(tok) if (x := self.weights.get(s)) is not None), 0.0)
        return x, self.leans.get(tok, 0.0)

    def read(self, ws: list[bytes], known: dict[bytes, tuple[float, float]]) -> tuple[list[tuple[int, int, float, float]], tuple[float, float, float]]:
        """(first word, end, score, -ln E) of every maximal segment with E below MAX_E; (evidence, nearness, lean)."""
        hits, previous, lean = [], None, 0.0
        for at, w in enumerate(ws):
            found = known.get(w)
            if found is None:
                known[w] = found = self.weight(w)
            x, part = found
            lean += part
            if x:
                hits.append((at, x if w != previous else 0.0))  # a word said over and over counts once
                previous = w
        lean /= len(ws) + LEAN_WORDS
        if not hits:
            return [], (0.0, -FAINT, lean)
        room = self.ln_k + math.log(len(ws))
        found = [(a, b, s, self.rate * s - room) for a, b, s in maximal_segments(hits)]
        best = max((x[3] for x in found), default=-FAINT)
        passages = [x for x in found if x[3] > -math.log(MAX_E)]
        return passages, (sum(x[3] for x in passages), min(0.0, max(-FAINT, best)), lean)

    def score(self, features: tuple[float, float, float]) -> float:
        z = sum(a * x for a, x in zip(self.slopes, design(features), strict=True)) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def design(features: tuple[float, float, float]) -> tuple[float, float, float]:
    """Features as the curve takes them."""
    evidence, nearness, lean = features
    return math.log1p(evidence), nearness / FAINT, lean


def maximal_segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time.

    ``hits`` are the (place, weight) of weighted words in order; every other
    place counts -DRIFT. Weights may be negative.
    """
    found: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one with a smaller sum before
    total, last = 0.0, -1
    for at, weight in hits:
        total -= DRIFT * (at - last - 1)
        last = at
        before, total = total, total + weight
        if weight <= 0:
            continue
        new = [at, at + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, standard deviations from 0) of words in so many toxic and clean documents, of all such occurrences."""
    size = min(n_toxic, n_clean)  # of the prior, in words
    prior = size * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (n_toxic + size - a)) - np.log(b / (n_clean + size - b))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def tables(counts: pd.DataFrame, n_toxic: float, n_clean: float) -> tuple[dict[bytes, float], dict[bytes, float], list[dict[bytes, float]]]:
    """Weights of the scan; parts of the lean; the latter as a clean and as a toxic training document sees them, itself left out."""
    if not len(counts) or not n_toxic or not n_clean:
        return {}, {}, [{}, {}]
    names, t, c = counts["token"], counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    delta, z = log_odds(t, c, n_toxic, n_clean)
    scan = (z >= MIN_Z) | (z <= -MIN_Z_CLEAN)
    is_word = np.array([not w.startswith(b"\0") for w in names])

    def leans(toxic: np.ndarray, clean: np.ndarray) -> dict[bytes, float]:
        there = is_word & (toxic >= 0) & (clean >= 0) & (toxic + clean >= MIN_COUNT - 1)
        delta, z = log_odds(np.maximum(toxic, 0), np.maximum(clean, 0), n_toxic, n_clean)
        keep = there & (np.abs(z) >= FAINT_Z)
        return dict(zip(names[keep], delta[keep].tolist()))

    return dict(zip(names[scan], (delta[scan] - DRIFT).tolist())), leans(t, c), [leans(t, c - 1), leans(t - 1, c)]


def extreme_value_rate(weights: dict[bytes, float], clean: dict[bytes, float], n_clean: float) -> float:
    """lambda > 0 with E[exp(lambda * score)] = 1 over clean words."""
    x = np.array([weights[w] for w in weights] or [1.0])
    p = np.array([clean.get(w, 0.0) + 0.5 for w in weights] or [0.5]) / max(n_clean, 1.0)
    rest = max(0.0, 1 - p.sum())
    low, high = 1e-6, 1.0
    excess = lambda r: float((p * np.exp(np.minimum(r * x, 600))).sum() + rest * math.exp(-DRIFT * r) - 1)
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """(slopes, bias) with smoothed targets and a little decay."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    columns = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(columns.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(columns @ w, -30, 30)))
        g = columns.T @ (q - target) + DECAY * w
        h = (columns * (q * (1 - q))[:, None]).T @ columns + DECAY * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w[:-1].tolist()), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Model from the labels outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    pick = lambda value, n: sampled_ids(known.where(F.col("toxic") == value).select("doc_id").distinct(), n, 3).withColumn("toxic", F.lit(value))
    sample = checkpoint(texts_of(docs.select("doc_id", "text"), pick(1, max_toxic).union(pick(0, max_clean))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for value, texts in part.groupby("toxic")["text"]:
                of = Counter()
                for text in texts:
                    tokens = {token(w) for w in words(text)}
                    of.update(tokens | {s for t in tokens for s in stems(t)})
                yield pd.DataFrame({"token": list(of), "toxic": value, "n": list(of.values())})

    counts = (
        sample.mapInPandas(count, "token binary, toxic int, n long")
        .groupBy("token")
        .agg(F.sum(F.col("n") * F.col("toxic")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("clean"))
    )
    is_word = ~F.startswith(F.col("token"), F.lit(b"\0"))
    n_toxic, n_clean = (x or 0 for x in counts.where(is_word).agg(F.sum("toxic"), F.sum("clean")).first())
    seen = counts.where(F.col("toxic") + F.col("clean") >= MIN_COUNT).toPandas()  # bounded by the sample
    seen["token"] = seen["token"].map(bytes)
    weights, leans, without = tables(seen, n_toxic, n_clean)
    model = Model(weights, leans)
    if not model.weights:
        return model
    model.rate = extreme_value_rate(model.weights, dict(zip(seen["token"], seen["clean"])), n_clean)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a document's own words would speak for its label, so it sees the others' counts
        views = [(replace(model, leans=x), {}) for x in without]
        for part in batches:
            ws = [words(t) for t in part["text"]]
            found = [views[y][0].read(w, views[y][1]) for w, y in zip(ws, part["toxic"])]
            top = [max((s for _, _, s, _ in f), default=0.0) for f, _ in found]
            features = np.array([design(x) for _, x in found]).reshape(-1, 3)
            yield pd.DataFrame({"toxic": part["toxic"], "n": [len(w) for w in ws], "best": top, "x": list(features)})

    schema = "toxic int, n long, best double, x array<double>"
    model.ln_k = -1e9  # every segment counts while K is fitted
    clean = sample.where("toxic = 0").mapInPandas(best, schema).where("best > 0").select("n", "best").toPandas()
    # the mean of a Gumbel variable is its mode plus Euler's constant over the rate
    model.ln_k = float(np.mean(model.rate * clean["best"] - np.log(clean["n"])) - np.euler_gamma) if len(clean) else 0.0
    got = sample.mapInPandas(best, schema).select("toxic", "x").toPandas()
    model.slopes, model.bias = logistic(np.array(got["x"].tolist()).reshape(-1, 3), got["toxic"].to_numpy(int))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passages, evidence, nearness, lean, score) of every row.

    passages: array of (first word, end word exclusive, score, -ln E).
    """
    schema = "passages array<struct<start:int,end:int,score:double,minus_ln_e:double>>, evidence double, nearness double, lean double, score double"

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.DataFrame:
        known: dict[bytes, tuple[float, float]] = {}
        spans, features = [], []
        for text in texts:
            if len(known) > 500_000:
                known.clear()
            at, of = model.read(words(text), known)
            spans.append([dict(zip(("start", "end", "score", "minus_ln_e"), x)) for x in at])
            features.append(of)
        columns = np.array(features, float).reshape(-1, 3).T
        named = dict(zip(("evidence", "nearness", "lean"), columns))
        return pd.DataFrame({"passages": pd.Series(spans, dtype=object), **named, "score": [model.score(x) for x in features]})

    return docs.select(id_col, found(F.col(text_col)).alias("found")).select(id_col, "found.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
