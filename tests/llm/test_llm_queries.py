"""Each registered query over its table: columns, rows, what is held out, and the SQL where there is one."""

import os
import zlib

import duckdb
import pytest

from tesselark.llm import queries

COLUMNS = {
    "op1_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op4_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"],
    "op10_html_text": ["page_id", "url", "text", "n_chars"],
    "op11_delta_lloyd": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}
#: Modulus and remainder of the ids that are kept from learning.
HELD_OUT = {"op2_language_id": (4, 2), "op5_toxicity": (4, 2), "op9_quality": (5, 0)}
#: Scores from which a text counts as of label 1.
LEAST = 0.3


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_gives_its_columns_for_every_row(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = found.collect()
    key = COLUMNS[name][0]
    if name == "op6_exact_top_k":
        ids = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
        assert sorted(r.query_id for r in rows) == sorted(i for i in ids if i % 50 == 0 for _ in range(5))
        return
    if key == "conv_id":
        assert sum(r.depth == 0 for r in rows) == 1 and all((r.parent_conv_id is None) == (r.depth == 0) for r in rows)
        return
    source = spark.read.parquet(f"{sf_dir}/{ {'page_id': 'pages', 'vec_id': 'embeddings'}.get(key, 'documents') }.parquet")
    ids = sorted(r[0] for r in source.select(key).collect())
    assert (sorted(set(r[key] for r in rows)) if name == "op4_best_fit_packing" else sorted(r[key] for r in rows)) == ids
    if name in HELD_OUT:
        n, rest = HELD_OUT[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1 for r in rows)
    if "predicted" in COLUMNS[name]:
        assert all(r.predicted == (r.score >= LEAST) for r in rows)
    if key == "page_id":
        assert all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    cursor = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()))
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf_dir).collect()) == want
