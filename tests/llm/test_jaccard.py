from __future__ import annotations

import collections
import random

import pytest

from vitrina.llm import jaccard_join as jj


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    at = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in at[x] if j > k).items():
            if 100 * n >= 75 * len(s | sets[j]):
                up[top(k)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return sorted(((d, len(sets[k]), least.get(top(k))) for k, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(df).collect()), key=str)


@pytest.fixture(scope="module")
def near_copies():
    """Chains, a large group of near copies, pairs around the threshold and unrelated texts that share a passage."""
    rng = random.Random(11)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(400)}"
    rows, base = [], [word() for _ in range(120)]
    for _ in range(60):
        text = list(base)
        text[rng.randrange(120)] = word()
        rows.append(text)
    chain = [word() for _ in range(80)]
    for k in range(12):
        chain = chain[:]
        chain[6 * k] = word()
        rows.append(chain)
    passage = [word() for _ in range(15)]
    rows += [[word() for _ in range(20)] + passage + [word() for _ in range(20)] for _ in range(40)]
    for n in range(1, 40):
        text = [word() for _ in range(n)]
        rows += [text, text + [word()], text[: max(1, n - 2)]]
    ids = rng.sample(range(1000), len(rows))
    return [(i, " ".join(t)) for i, t in zip(ids, rows)]


@pytest.mark.parametrize("tile", [2048, 4])
def test_against_all_pairs(frame, near_copies, awkward, tile, monkeypatch):
    monkeypatch.setattr(jj, "TILE", tile)
    monkeypatch.setattr(jj, "TILE_SHINGLES", 500 * tile)
    rows = near_copies + [(None if i is None else i + 2000, t) for i, t in awkward]
    assert found(frame(rows)) == brute(rows)


def test_no_rows_and_no_links(frame, empty):
    assert found(empty) == []
    assert found(frame([(1, None), (2, ""), (3, "a b c"), (4, "d")])) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4)]


def test_first_of_each_group_stays(frame, awkward):
    docs = frame(awkward)
    kept = jj.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 1, 2, 3, 4, 5, 8, 10], key=str)


def test_each_component_keeps_a_row_when_ids_repeat(frame):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(6, text("a")), (6, text("b")), (9, text("b") + " end"), (6, text("c")), (6, text("c") + " end"), (3, text("d")), (6, text("d")), (6, text("d"))]
    rows += [(None, text("e")), (None, text("e") + " end"), (None, text("f")), (None, text("b")), (6, ""), (6, ""), (6, None)]
    kept = sorted(((r.doc_id, r.text) for r in jj.keep_first(frame(rows)).collect()), key=str)
    assert [i for i, t in kept if t and t[0] == "c"] == [i for i, t in kept if t and t[0] == "c"][:1] == [6]
    assert [i for i, t in kept if t and t[0] == "e"] == [None]
    rest = [(i, t) for i, t in kept if not t or t[0] not in "ce"]
    assert rest == sorted([(6, text("a")), (6, text("b")), (3, text("d")), (None, text("f")), (6, ""), (6, None)], key=str)


def test_each_class_gets_one_text(frame, monkeypatch):
    texts = [" ".join(f"{n}x{k}" for k in range(40)) + end for n in range(12) for end in ("", " end")]
    rows = [(i, t) for i, t in zip([None] * 16 + [7] * 8, texts)] * 2 + [(None, "other")] * 30 + [(7, "more")] * 30
    seen, real = [], jj.checkpoint

    def checkpoint(df):
        out = real(df)
        seen.extend(r.c2 for r in out.collect()) if out.columns == ["c2", "text"] else None
        return out

    monkeypatch.setattr(jj, "checkpoint", checkpoint)
    assert found(frame(rows)) == brute(rows)
    assert len(seen) == len(set(seen)) == 24


def test_tree_finds_what_the_bound_allows():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64)) for _ in range(60)]
    for k in range(240):
        own = sets[k % 60]
        sets.append(np.unique(np.append(own[rng.random(len(own)) < 0.9], rng.integers(0, 1 << 62, max(1, len(own) // 10)).astype(np.uint64))))
    sizes, points = np.array([len(s) for s in sets]), [jj.point(s) for s in sets]
    forest, overlaps, every = jj.Forest(sizes, points), jj.Overlaps(sets), np.ones(300, bool)
    for k in range(0, 300, 7):
        exact = np.array([len(np.intersect1d(sets[k], s)) for s in sets])
        assert (overlaps.of(k) == exact).all()
        links = set(np.flatnonzero(7 * exact >= 3 * (sizes + sizes[k])))
        found = set(forest.near(k, every))
        assert links <= found and (sizes[k] < 200 or len(found) < 40)


@pytest.mark.parametrize("keys,edges_a_task", [(None, 0), (None, 3)])
def test_exact_prefixes_and_rounds_of_joins(frame, near_copies, keys, edges_a_task):
    """All keys of the prefix filter; components by star rounds, as for many edges."""
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(frame(near_copies), keys=keys, edges_a_task=edges_a_task).collect()), key=str)
    assert got == brute(near_copies)
