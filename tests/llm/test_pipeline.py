from __future__ import annotations

import re

import duckdb
import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import SF0001
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import base, plain_runs
from vitrina.llm import bpe, mixing, quality, secrets


def test_stages_one_by_one(spark, documents, labels):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    good = stages["quality"](spark, documents, SF0001).cache()
    assert good.columns == documents.columns
    scores = {r.doc_id: r.score for r in quality.score(documents, quality.train(documents, labels)).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}

    single = stages["near_duplicates"](spark, good, SF0001).cache()
    assert single.columns == documents.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in good.collect()])})

    clean = stages["secrets"](spark, single, SF0001).cache()
    assert clean.columns == documents.columns and clean.count() == single.count()
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert base(r.text) == "" and r.n_chars == len(r.text)
        if base(texts[r.doc_id]) == "" and "[SECRET]" not in r.text:
            assert r.text == texts[r.doc_id]

    mixed = stages["mix"](spark, clean, SF0001).cache()
    assert mixed.columns == documents.columns
    words = F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("w")
    want = {r.source: r.w for r in mixing.mix(clean).groupBy("source").agg(F.sum("taken").alias("w")).where("w > 0").collect()}
    assert {r.source: r.w for r in mixed.groupBy("source").agg(words).collect()} == want

    tokens = stages["tokens"](spark, mixed, SF0001)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in tokens.limit(30).collect():
        assert r.n_tokens == len(library.encode(r.decoded, add_special_tokens=False).ids) == len(r.ids) // 4
    assert sorted(r.decoded for r in tokens.collect()) == sorted(r.text for r in mixed.collect())


def test_run_and_empty_table(spark, documents, tmp_path, labels):
    assert corpus_pipeline.run(spark, SF0001).count() > 0
    documents.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_redacted(text, model):
    """The text with every secret masked: base spans and random parts, overlapping ones as one."""
    if text is None:
        return None
    spans = [tuple(map(int, x.split(":")[1:])) for x in [*base(text).split(","), *plain_runs(text, model)] if x]
    merged = []
    for a, e in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e])
    out, at = "", 0
    for a, e in merged:
        out, at = out + text[at:a] + secrets.MARK, e
    return out + text[at:]


def test_every_row_of_the_run_against_plain_stages(spark, documents, labels, tmp_path):
    """(doc_id, ids) of run() on the whole small table: the stages one after the other in plain Python and DuckDB."""
    scores = {r.doc_id: r.score for r in quality.score(documents, quality.train(documents, labels)).collect()}  # checked in test_quality
    rows = [r for r in documents.collect() if scores[r.doc_id] >= 0.3]
    first = {c for _, _, c in brute([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in first]
    model = secrets.train(spark.createDataFrame(rows, documents.schema))  # checked in test_secrets
    rows = [(r.doc_id, plain_redacted(r.text, model), r.lang, r.source) for r in rows]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[3] for r in rows]})
    con = duckdb.connect()
    con.register("documents", table)
    taken = {i: (size, n) for i, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall()}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    want = []
    for i, text, _, _ in rows:
        size, n = taken[i]
        texts = [text] * (n // size if size else 0)
        if size and n % size:
            ends = [m.end() for m in re.finditer(mixing.WORD, text)]
            texts.append(text[: ends[n % size - 1]])
        want += [(i, library.encode(x, add_special_tokens=False).ids) for x in texts]
    got = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in corpus_pipeline.run(spark, SF0001).collect()]
    assert sorted(got) == sorted(want)
