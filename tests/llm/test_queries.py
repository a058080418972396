import duckdb
import pytest

from docloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {  # the contracts' columns come first
    "op1_html_template": ["page_id", "url", "text", "n_chars"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4_decontamination": ["doc_id", "item_id"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_quality_lines": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_bestfit": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8_line_dedup": ["doc_id", "n_lines", "n_removed", "text"],
    "op9_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op10_parity_join": ["doc_id", "n_shingles", "component_id"],
    "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tmp_path, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    df.write.parquet(f"{tmp_path}/got")
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    n = c.execute(f"SELECT count(*) FROM '{tmp_path}/got/*.parquet'").fetchall()[0][0]
    if name not in ("op4_decontamination", "op7_bestfit", "op11_prefix_trie"):
        source = "pages" if name in ("op1_html_template", "op5_warc") else "documents"
        assert n == c.execute(f"SELECT count(*) FROM {source}").fetchall()[0][0]
    if name in ORACLE:
        cols = ", ".join(f'"{x}"' for x in sorted(df.columns))
        want, got = f"SELECT {cols} FROM ({ORACLE[name]})", f"SELECT {cols} FROM '{tmp_path}/got/*.parquet'"
        assert c.execute(f"SELECT count(*) FROM (({want}) EXCEPT ALL ({got}) UNION ALL (({got}) EXCEPT ALL ({want})))").fetchall() == [(0,)]


def test_every_operator_has_a_query():
    assert list(QUERIES) == list(COLUMNS)
