"""The registered queries over the smallest driver tables: their columns, their row counts and, where there is one, their SQL."""

import os

import duckdb
import pytest

from concourse.llm.oracles import SQL
from concourse.llm.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
COLUMNS = {
    "op1_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2_ngram_jaccard": "doc_id n_shingles component_id",
    "op3_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_token_output": "doc_id start n_tokens ids_crc32",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_decontamination": "doc_id item_id distance",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_quality_classifier": "doc_id held_out score predicted",
    "op9_line_dedup": "doc_id n_lines n_removed_lines kept_sha256",
    "op10_url_filters": "page_id host path rule verdict",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13_embedding_near_dedup": "vec_id n_links component_id kept",
}
PER_DOCUMENT = {k for k in COLUMNS if k.split("_")[0] in ("op2", "op3", "op4", "op7", "op8", "op9", "op11", "op12")}


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_query(spark, key):
    frame = QUERIES[key](spark, FOLDER)
    assert set(COLUMNS[key].split()) <= set(frame.columns)
    rows = frame.collect()
    if key in PER_DOCUMENT:
        ids = sorted(r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/documents.parquet'").fetchall())
        assert sorted(r["doc_id"] for r in rows) == ids
    if key in SQL:
        con = duckdb.connect()
        for name in ("documents", "conversations", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
        found = con.execute(SQL[key])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(frame.columns)
        by_text = lambda r: tuple(map(str, r))
        assert sorted((tuple(r[n] for n in names) for r in rows), key=by_text) == sorted(found.fetchall(), key=by_text)
