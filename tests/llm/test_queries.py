"""The registered queries: whole tables, the columns and types that are agreed on, and DuckDB where there is SQL."""

from collections import Counter

import duckdb
import pytest

from stepfold.llm.queries import ORACLE_SQL, QUERIES

from . import cases

COLUMNS = {
    "op1_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op13_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op10_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.mark.skipif(not cases.has_data(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    out = QUERIES[name](spark, cases.DATA)
    types = dict(out.dtypes)
    assert all(types.get(c) == kind for c, kind in (x.split() for x in COLUMNS[name].split(", "))), types
    rows = out.collect()
    key = "page_id" if name.startswith("op10") else "doc_id"
    source = spark.read.parquet(f"{cases.DATA}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    ids = Counter(r[0] for r in source.select(key).collect())
    if name == "op13_ranked_search":
        assert {r[key] for r in rows} <= set(ids)
    elif name != "op5_packing":
        assert Counter(r[key] for r in rows) == ids
    else:
        assert {r[key] for r in rows} == set(ids)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{cases.DATA}/{t}.parquet')")
        got = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in got.description]
        assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(got.fetchall())
