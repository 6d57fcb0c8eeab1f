from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF0001
from vitrina.llm import lm_score as lm
from vitrina.llm.common import fold


class Plain:
    """The same model by dictionaries of tuples."""

    def __init__(self, rows, order):
        self.order, self.texts, self.counts, self.starts = order, [], [collections.Counter() for _ in range(order + 1)], 0
        for i, t in rows:
            s = ["<s>", *(t or "").encode().lower().split(), "</s>"]
            train = i is None or zlib.crc32(str(i).encode()) % 10 != 0
            self.texts.append((i, s, train))
            self.starts += train
            for k in range(1, len(s) * train):
                for n in range(1, min(order, k + 1) + 1):
                    self.counts[n][tuple(s[k - n + 1 : k + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])

    def p(self, x):
        if len(x) == 1:
            return (self.counts[1][x] + 0.1) / (self.n + 0.1 * (self.v + 1))
        d = self.starts if x[:-1] == ("<s>",) else self.counts[len(x) - 1][x[:-1]]
        m = lm.STRENGTH * d**lm.POWER
        return (self.counts[len(x)][x] + m * self.p(x[1:])) / (d + m) if d else self.p(x[1:])

    def rows(self):
        for i, s, train in self.texts:
            grams = [tuple(s[max(0, k - self.order + 1) : k + 1]) for k in range(1, len(s))]
            known = sum(self.counts[1][(x,)] > 0 for x in s[1:])
            yield i, not train, len(s) - 1, known, self.n, sum(math.log10(self.p((x,))) for x in s[1:]), sum(math.log10(self.p(g)) for g in grams)


@pytest.mark.parametrize("order,block", [(1, 10**9), (2, 30_000), (3, 50_000)])
def test_against_dictionaries(frame, documents, awkward, order, block):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(None if i is None else 5000 + i, t) for i, t in awkward]
    got = lm.score(frame(rows), fold(F.col("doc_id"), lm.FOLDS) != lm.HELD_OUT, order=order, block_chars=block).collect()
    key = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(Plain(rows, order).rows(), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_probabilities_add_up(documents):
    model = Plain([(r.doc_id, r.text) for r in documents.limit(30).collect()], 2)
    words = [w for (w,) in model.counts[1]] + ["unseen"]
    for context in ("<s>", words[0], words[5]):
        assert sum(model.p((context, w)) for w in words) == pytest.approx(1)


def test_no_rows(empty):
    assert lm.score(empty, F.lit(True)).count() == 0


def test_query_scores_by_trigrams(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {i: score for i, *_, score in Plain(rows, 3).rows()}
    assert {r.doc_id: r.score for r in lm.op4_lm(spark, SF0001).collect()} == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_packing_loses_nothing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5_000):
        hashes = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        counts = rng.choice([0, 1, 254, 255, 256, 1 << 40], n)
        assert (lm._unpacked_hashes(lm._packed_hashes(hashes)) == hashes).all()
        assert (lm._unpacked(lm._packed(counts), n) == counts).all()
    packed = lm._packed_hashes(np.unique(rng.integers(0, 1 << 64, 200_000, np.uint64)))
    assert len(packed) < 6.3 * 200_000


def test_walk_carries_the_state():
    """One text, step by step: an arc, a failure arc, a state that training never saw, and back up."""
    nan = np.nan
    model = lm.Automaton.__new__(lm.Automaton)
    model.arc = [np.array([-1.0, -2.0, -3.0, -4.0]), np.array([-0.1, nan, -0.3, nan]), np.array([nan, nan, -0.03, nan])]
    model.fail = [np.zeros(4), np.array([-0.5, -0.6, -0.7, nan]), np.array([nan, -0.06, -0.07, -0.08])]
    places = [np.arange(4, dtype=np.int32)] * 3
    whole = [np.ones(4, bool), np.ones(4, bool), np.array([False, True, True, True])]
    # 0: bigram arc from the start; 1: trigram state without arc fails, so does the bigram state, a unigram arc;
    # 2: only one word is remembered, so the trigram arc is out of reach; 3: trigram state fails, the bigram state is unknown
    want = -0.1 + (-0.06 - 0.6 - 2.0) - 0.3 + (-0.08 - 4.0)
    assert model.walk(places, whole, np.array([0]), np.array([4])) == pytest.approx([want])


def test_texts_walk_side_by_side(frame):
    """Texts of very different lengths in one block, the longest of 30,000 words."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{k}" for k in rng.zipf(1.5, n) % 50)
    rows = [(k, word(int(n))) for k, n in enumerate([0, 1, 2, 30_000, 5, 700, 3])]
    got = {r.doc_id: r.score for r in lm.score(frame(rows), fold(F.col("doc_id"), lm.FOLDS) != lm.HELD_OUT).collect()}
    assert got == pytest.approx({i: score for i, *_, score in Plain(rows, 3).rows()}, rel=1e-9, abs=1e-9)


def test_equal_rows_are_spread_over_blocks(frame):
    """Repeated rows fall into several blocks, and every one counts and is scored."""
    rows = [(1, "a b c d " * 30)] * 400 + [(2, "x y"), (None, "x z")]
    got = lm.score(frame(rows).repartition(3), fold(F.col("doc_id"), lm.FOLDS) != lm.HELD_OUT, block_chars=5_000).collect()
    key = lambda r: (str(r[0]), r[2], r[6])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(Plain(rows, 3).rows(), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
