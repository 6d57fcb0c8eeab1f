"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose label says quality 1; the unlabelled set
is web text drawn from all documents without looking at labels. Labels 0 are not
used. A first classifier tells positives from unlabelled text; the smallest
ratio of the shares of unlabelled and positive texts above a score estimates the
class prior (each half scored by the classifier of the other). The final
classifier minimises the non-negative unbiased risk

    prior * L(P, +) + max(0, L(U, -) - prior * L(P, -))

with logistic loss; where the second part turns negative, its gradient is
followed upwards instead. Scores are the logits put on the scale of the positives'
share, which the prior and the two sets' densities give. The model is linear in quantile bins of text
statistics (byte classes, word lengths, repetition), which need one pass over
the text and no vocabulary.

Fitting uses at most ``max_positive`` and ``max_unlabelled`` documents (the
first by a hash of the id); their statistics are collected by the driver. All
documents are scored, in tasks, without a shuffle.

Defined cases: null text counts as empty and has statistics 0; a very long text is
read whole, in memory in proportion to its words; texts with equal statistics score
equally; null ids are held
out of fitting and have ``held_out`` false; repeated rows repeat; without
positives or documents the score is 0.5 for every row; an empty table gives an
empty result. Other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read_table, sampled_ids, texts_of

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
BINS = 10
STEPS, DECAY = 300, 1e-4

#: Byte classes whose shares are statistics.
_CLASS = np.full(256, 0)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\v\f", b"\n"), 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 6
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
for _k, _byte in enumerate(_PUNCTUATION, 7):
    _CLASS[_byte] = _k
N_CLASSES = 7 + len(_PUNCTUATION)
N_FEATURES = N_CLASSES + 12


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    out[:N_CLASSES] = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), N_CLASSES) / len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return out
    lengths = np.fromiter(map(len, words), np.int32, n)
    counts = Counter(words)
    lines = raw.split(b"\n")
    k = N_CLASSES
    out[k : k + 12] = (
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        (lengths <= 2).mean(),
        len(counts) / n,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
        len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
    )
    return out


@dataclass
class Model:
    """Bin edges (features x bins - 1), weights (features x bins), the prior, and the curve from logit to score."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    at: np.ndarray
    share: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[np.arange(len(self.edges)), _bins(x, self.edges)].sum(1) + self.bias
        return 0.999 * np.interp(z, self.at, self.share) + 0.001 * _sigmoid(z)


def _edges(x: np.ndarray) -> np.ndarray:
    """Upper ends of a statistic's bins: quantiles, with a bin of its own for 0 where that is common."""
    above = x[x > 0]
    if len(above) > 0.9 * len(x) or not len(above):
        return np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])
    return np.concatenate([[0.0], np.quantile(above, np.linspace(0, 1, BINS)[1:-1])])


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Cells:
    """Rows as the cells (feature, bin) they fall in, and one cell for the bias."""

    def __init__(self, x: np.ndarray, edges: np.ndarray):
        cells = _bins(x, edges) + np.arange(len(edges)) * BINS
        self.cells = np.concatenate([cells, np.full((len(x), 1), len(edges) * BINS)], 1).astype(np.int32)

    def __getitem__(self, rows: np.ndarray) -> _Cells:
        out = object.__new__(_Cells)
        out.cells = self.cells[rows]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return w[self.cells].sum(1)

    def mean(self, values: np.ndarray, size: int) -> np.ndarray:
        """Mean over rows of value x cell indicators."""
        return np.bincount(self.cells.ravel(), np.repeat(values, self.cells.shape[1]), size) / max(1, len(values))


def _descend(gradient, size: int, steps: int = STEPS, rate: float = 0.05, decay: float = DECAY) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: _Cells, u: _Cells, size: int) -> float:
    """Share of positives in u: the least ratio of the two sets' shares above a score.

    Each half is scored by a classifier (positive against unlabelled) of the other.
    """
    rng = np.random.default_rng(0)
    halves = [np.array_split(rng.permutation(len(x.cells)), 2) for x in (p, u)]
    ratios = []
    for own, other in ((0, 1), (1, 0)):
        a, b = p[halves[0][own]], u[halves[1][own]]
        w = _descend(lambda w: a.mean(_sigmoid(a.dot(w)) - 1, size) + b.mean(_sigmoid(b.dot(w)), size), size)  # noqa: B023
        of_p, of_u = np.sort(p[halves[0][other]].dot(w)), np.sort(u[halves[1][other]].dot(w))
        at = np.quantile(of_p, np.linspace(0, 0.5, 51))
        share = lambda s: 1 - np.searchsorted(s, at, side="left") / max(1, len(s))  # noqa: B023, E731
        ratios.append(np.min(share(of_u) / np.maximum(share(of_p), 1e-9)))
    return float(np.clip(np.mean(ratios), 0.05, 0.98))


def _calibrated(zp: np.ndarray, zu: np.ndarray, prior: float, cells: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Share of positives among unlabelled texts by logit: prior times the ratio of densities, made monotone.

    Cells hold equal numbers of unlabelled texts; adjacent cells that fall are pooled.
    """
    cuts = np.unique(np.quantile(zu, np.linspace(0, 1, cells + 1)[1:-1]))
    count = lambda z: np.bincount(np.searchsorted(cuts, z, side="right"), minlength=len(cuts) + 1)
    positive, all_ = prior * count(zp) / len(zp), count(zu) / len(zu)
    pools: list[list[float]] = []
    for k in range(len(cuts) + 1):
        pools.append([positive[k], max(all_[k], 1e-9), 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    share = np.repeat([min(1.0, x / y) for x, y, _ in pools], [int(n) for _, _, n in pools])
    ends = np.concatenate([[min(zu.min(), zp.min())], cuts, [max(zu.max(), zp.max())]])
    return (ends[:-1] + ends[1:]) / 2, share


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    if len(positive) < 2 or len(unlabelled) < 2:
        half = np.array([0.5])
        return Model(np.zeros((N_FEATURES, BINS - 1)), np.zeros((N_FEATURES, BINS)), 0.0, 0.5, np.zeros(1), half)
    edges = np.stack([_edges(x) for x in np.concatenate([positive, unlabelled]).T])
    size = N_FEATURES * BINS + 1
    p, u = _Cells(positive, edges), _Cells(unlabelled, edges)
    prior = estimate_prior(p, u, size)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = np.clip(p.dot(w), -30, 30), np.clip(u.dot(w), -30, 30)
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        of_negative = u.mean(_sigmoid(zu), size) - prior * p.mean(_sigmoid(zp), size)
        if negative < 0:
            return -of_negative
        return prior * p.mean(_sigmoid(zp) - 1, size) + of_negative

    w = _descend(gradient, size)
    return Model(edges, w[:-1].reshape(N_FEATURES, BINS), float(w[-1]), prior, *_calibrated(p.dot(w), u.dot(w), prior))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Model from the labels outside the held-out fold. Collects the statistics of the bounded samples."""
    trusted = labels.where((F.col("quality") == 1) & (fold(F.col("doc_id"), FOLDS) > HELD_OUT)).select("doc_id").distinct()
    ids = sampled_ids(trusted, max_positive, 1).withColumn("positive", F.lit(True)).union(
        sampled_ids(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), max_unlabelled, 2).withColumn("positive", F.lit(False))
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"positive": part["positive"], "x": [statistics(t).tolist() for t in part["text"]]})

    got = texts_of(docs.select("doc_id", "text"), ids).mapInPandas(task, "positive boolean, x array<float>").toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(-1, N_FEATURES)
    mask = got["positive"].to_numpy(bool)
    return fit(x[mask], x[~mask])


def scorer(model: Model):
    """Column function: text -> score."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], np.float32).reshape(-1, N_FEATURES)
        return pd.Series(model.scores(x).astype(float))

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    return docs.select(id_col, scorer(model)(F.col(text_col)).alias("score"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept."""
    return docs.where(scorer(model)(F.col(text_col)) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
