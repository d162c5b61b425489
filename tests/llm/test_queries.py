"""The registered queries: those with SQL against DuckDB, all for their columns."""

import duckdb
import pytest

from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.comparing import TABLES, differences

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_sentencepiece": ["doc_id"],
    "op9_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op12_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op13_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert not differences(QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    assert set(COLUMNS[name]) <= set(QUERIES[name](spark, sf_dir).columns)
