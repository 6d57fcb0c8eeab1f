from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.conftest import SF0001
from vitrina.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_equals_the_library(library):
    rng = random.Random(0)
    ranges = ((9, 14), (32, 127), (128, 0x3000), (0x3000, 0xD000), (0x10000, 0x11000))
    texts = ["", " ", "  a  b \n\n c", "<|endoftext|>x<|endoftext|><|endoftext|> y", "x" * 3000, "'s 'S don't we'LL", "\x00\x01", "1a2b٣٤"]
    texts += ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(60)) for _ in range(400)]
    codec = bpe.Codec(open(bpe.default_vocabulary(), encoding="utf-8").read(), remembered=50)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_rows(frame, awkward, empty, library):
    rows = bpe.encode(frame(awkward)).collect()
    want = sorted((str(i), np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t in awkward)
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in rows) == want
    assert bpe.encode(empty).count() == 0


def test_query_columns_equal_the_library(spark, documents, library):
    import hashlib

    want = []
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op8_bpe(spark, SF0001).collect()]
    assert sorted(got) == sorted(want)
