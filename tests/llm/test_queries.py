"""Every registered operator query over whole tables: SQL where there is some, else shape and brute force."""

from __future__ import annotations

import pytest

from tests.compare import compare, duck
from tests.llm.conftest import SF0001
from vitrina.llm import registry


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_matches_sql(spark, key):
    ok, message = compare(registry.QUERIES[key](spark, SF0001), duck(SF0001), registry.ORACLE[key])
    assert ok, message


COLUMNS = {
    "op3_jaccard": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op4_lm": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op5_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op6_secrets": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op8_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op9_nearest": "query_id:bigint rank:int vec_id:bigint score:double",
    "op10_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op12_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
}


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_whole_table(spark, documents, key):
    df = registry.QUERIES[key](spark, SF0001)
    assert " ".join(f"{c}:{t}" for c, t in df.dtypes) == COLUMNS[key]
    if key not in ("op9_nearest", "op12_packing"):
        assert sorted(r.doc_id for r in df.collect()) == sorted(r.doc_id for r in documents.select("doc_id").collect())


def test_every_operator_is_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
    assert "pipeline" in names
    assert set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
