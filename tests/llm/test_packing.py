from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import SF0001
from vitrina.llm import packing


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(packing.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, rows, capacity):
    """(doc_id, piece, start, length, ids) by the library, one text at a time."""
    out = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        out += [(i, k, a, b - a, struct.pack(f"<{b - a}I", *ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def check_places(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; returns how many there are."""
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


def test_query_on_the_whole_table(spark, documents, library):
    rows = packing.op12_packing(spark, SF0001).collect()
    want = expected(library, [(r.doc_id, r.text) for r in documents.collect()], 2048)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((i, k, a, n, zlib.crc32(b)) for i, k, a, n, b in want)
    assert check_places(rows, 2048) == -(-sum(r.length for r in rows) // 2048)  # the least that any packing could need


def test_awkward_rows_and_whole_sequences(frame, awkward, library):
    docs = frame(awkward).repartition(3)
    placed = packing.place(packing.pieces(docs, capacity=100), 100).cache()
    rows = placed.collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows), key=key) == sorted(expected(library, awkward, 100), key=key)
    check_places(rows, 100)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in rows:
        s = whole[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and s.length * 4 == len(s.ids)


def test_encoder_equals_the_library(library):
    """Random texts over all of Unicode, special tokens and white space, and runs that the fast engine refuses."""
    with open(packing.default_vocabulary(), encoding="utf-8") as f:
        encode = packing.Encoder(f.read())
    assert encode.fast
    rng = random.Random(9)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff"]
    kinds = [lambda: rng.choice(spaces), lambda: rng.choice(" 'stremvdl\n\t"), lambda: "<|endoftext|>", lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])), lambda: rng.choice("abcABC019!?.é日")]
    texts = ["".join(rng.choices(kinds, weights=[3, 3, 0.3, 3, 5])[0]() for _ in range(rng.randint(0, 60))) for _ in range(3_000)]
    texts += [" " * 700_000 + "x", "a" * 200_000, "\n" * 600_000]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    encode = packing.Encoder(spec)
    assert encode.fast is None
    assert encode("Some Words here") == Tokenizer.from_str(spec).encode("Some Words here", add_special_tokens=False).ids


def test_empty_table(empty):
    assert packing.place(packing.pieces(empty)).collect() == []


def test_place_of_any_rows(spark):
    rng = random.Random(3)
    lengths = [rng.choice([7, 7, 7, 20, 33, rng.randint(1, 50)]) for _ in range(3_000)]
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(lengths)], "i long, length long, sequence_note string").repartition(7)
    rows = packing.place(df, 50).collect()
    assert sorted((r.i, r.length) for r in rows) == list(enumerate(lengths))
    assert check_places(rows, 50) <= best_fit_one_by_one(lengths, 50)
    with pytest.raises(Exception, match="lengths must be"):
        packing.place(df, 20)


def best_fit_one_by_one(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place."""
    best = len(lengths)
    order = sorted(lengths, reverse=True)

    def go(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(order):
            best = len(gaps)
            return
        for g in {g for g in gaps if g >= order[k]}:
            at = gaps.index(g)
            go(k + 1, [*gaps[:at], g - order[k], *gaps[at + 1 :]])
        go(k + 1, [*gaps, capacity - order[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 64])
    lengths = [rng.randint(1, capacity) if seed % 2 else rng.choice([1, 3, capacity // 2, capacity // 3 + 1, capacity]) for _ in range(rng.choice([1, 8, 9, 400]))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    patterns = packing.plan(counts, capacity)
    placed = np.zeros(capacity + 1, int)
    for times, runs in patterns:
        assert times > 0 and sum(n * k for n, k in runs) <= capacity
        for n, k in runs:
            placed[n] += times * k
    assert (placed == counts).all()
    used = sum(times for times, _ in patterns)
    assert used <= best_fit_one_by_one(lengths, capacity)
    if len(lengths) < 10:
        assert used <= fewest(lengths, capacity) + 1
    if len(lengths) == 400 and seed % 2:
        assert used <= -(-sum(lengths) // capacity) * 1.03 + 1


def test_exact_complements_are_found():
    left = np.zeros(101, np.int64)
    left[[60, 30, 7, 3]] = 5
    assert packing.plan(left, 100) == [(5, [(60, 1), (30, 1), (7, 1), (3, 1)])]


def test_plan_grows_with_lengths_not_with_rows():
    rng = np.random.default_rng(5)
    few = packing.plan(np.bincount(rng.integers(1, 2049, 20_000), minlength=2049))
    many = packing.plan(np.bincount(rng.integers(1, 2049, 20_000), minlength=2049) * 1_000_000)
    assert sum(len(r) for _, r in many) < 3 * sum(len(r) for _, r in few) + 10_000
