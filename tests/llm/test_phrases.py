from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from vitrina.llm import phrases as P


def plain(rows, min_count=10, max_words=3, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) in plain Python."""
    out = []
    by_lang = defaultdict(list)
    for text, lang in rows:
        by_lang["und" if lang is None else lang].append(text or "")
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text)):
                ws = re.findall(r"[^ \t]+", piece)
                n += len(ws)
                f.update(tuple(ws[i : i + m]) for m in range(1, max_words + 1) for i in range(len(ws) - m + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < 50 * a:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(seed, size=400):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "times", "é", "日本", "x" * 40, *(f"w{k}" for k in range(30))]
    words = lambda k: " ".join(rng.choices(vocabulary, weights=[30, 10, 10, 6, 6, 6, 3, 3, 2, *[1] * 30], k=k))
    rows = [(words(rng.randint(1, 40)).replace(" w7 ", rng.choice([". ", ",", "\n", "\t", "  ", "; ", " "])), rng.choice(["en", "en", "de", None])) for _ in range(size)]
    rows += [("the end of the new york times", "fr")] * 60 + [("", "en"), (None, "en"), (" \t.,!", "xx"), ("The", None)]
    rows.append((words(20_000), "en"))
    return rows


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("budget,block_chars", [(1_500_000, 6_000_000), (400, 3_000), (3_000, 20_000)])
def test_against_plain_python(spark, budget, block_chars):
    """Small budgets bring prefixes of one, two and three words, in many groups."""
    rows = made(1)
    df = spark.createDataFrame([(i % 50, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f long, score long")
    assert collected(P.collocations(df.repartition(4), budget=budget, block_chars=block_chars)) == plain(rows)


def test_heavy_prefixes_are_really_extended(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, "text string, lang string")
    words = P.prefix_counts(df.where("text <> ''").na.fill("und", ["lang"]).select("lang", "text"), 1, [], 10**6)
    assert words.where("f > 50").count() > 5  # limit of budget 400


@pytest.mark.parametrize("max_words,min_count", [(2, 3), (4, 5)])
def test_other_lengths(spark, max_words, min_count):
    rows = made(2, 150)
    df = spark.createDataFrame(rows, "text string, lang string")
    found = P.collocations(df, min_count=min_count, max_words=max_words, top=50, budget=1_000, block_chars=2_000)
    assert collected(found) == plain(rows, min_count, max_words, 50)


def test_top_of_a_large_language(spark):
    rows = [(f"a{k} b{k}. " * (10 + k % 3), "en") for k in range(2_300)]
    found = collected(P.collocations(spark.createDataFrame(rows, "text string, lang string")))
    assert len(found) == 2_000 and found == plain(rows)


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert P.collocations(spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string")).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    a, l, r = 3_000_000_000, 5_000_000_001, 7_000_000_003
    got = spark.range(1).selectExpr(f"{a}L AS a", f"{l}L AS l", f"{r}L AS r").select(P.score_of("a", "l", "r")).first()[0]
    assert got == 1_000_000 * a * a // (l * r)
