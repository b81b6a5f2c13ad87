"""The registered queries over the smallest tables: their columns, and their SQL where there is some."""

import os

import pytest
from plumbline.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_html_text": {"page_id", "url", "text", "n_chars"},
    "op2_token_counts": {"doc_id", "n_tokens"},
    "op3_near_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op4_line_dedup": {"doc_id", "text"},
    "op5_decontamination": {"doc_id", "item_id"},
    "op6_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op9_token_ids": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_importance_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13_virtual_slots": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def test_all_are_registered():
    assert set(QUERIES) == set(CONTRACT)


@pytest.mark.parametrize("name", CONTRACT)
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert set(df.columns) >= CONTRACT[name]
    rows = df.collect()
    assert rows
    if name in ORACLES:
        import duckdb

        connection = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "benchmark"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        columns = sorted(df.columns)
        want = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((tuple(r) for r in want), key=repr)
