"""The queries of llm at the smallest scale."""

from __future__ import annotations

import zlib

import pytest

from docloom.llm.oracle import ORACLE
from docloom.llm.queries import QUERIES
from tests import compare

pytestmark = pytest.mark.skipif(not compare.has_data(), reason="no test data here")

COLUMNS = {
    "op1_url_filter": "page_id host path rule verdict",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_exact_top_k": "query_id rank vec_id score",
    "op4_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_jaccard_join": "doc_id n_shingles component_id",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_sentencepiece": "doc_id token_ids n_tokens decoded_crc32 round_trip",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_source_mixing": "doc_id domain lang source epoch n_tokens leaf_budget",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows(spark, name):
    compare.assert_same(spark, compare.duck(), QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ORACLE])
def test_columns_and_folds(spark, name):
    df = QUERIES[name](spark, compare.DATA)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = df.collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{compare.DATA}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    folds = {"op2_language_id": 5, "op6_toxicity": 5, "op4_lm_scoring": 10}.get(name)
    if folds:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == 0) for r in rows)
