"""The registered queries: names, columns, and DuckDB where SQL can say it."""

import __spark_entry__ as entry
import pytest
from compare import compare, duck
from conftest import SF001, SF01

COLUMNS = {
    "op1": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op2": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op3": {"query_id", "rank", "vec_id", "score"},
    "op4": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op5": {"doc_id", "item_id"}, "op6": {"doc_id", "earlier_id"},
    "op7": {"doc_id", "held_out", "score", "predicted"},
    "op8": {"doc_id", "n_shingles", "component_id", "kept"},
    "op9": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op10": {"page_id", "host", "path", "rule", "verdict"},
    "op11": {"item_id", "rank", "doc_id", "score"},
    "op12": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op13": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
}


def test_one_query_per_operator_and_the_pipeline():
    names = list(entry.queries())
    for op in COLUMNS:
        assert sum(n.startswith(op + "_") for n in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op3_vantage_point_search", "op8_minhash_bayes", "op9_warc_index",
                                  "op11_range_maximum_search", "op13_counted_infill"])
def test_query_matches_duckdb(spark, name):
    res = compare(spark, duck(SF01), name, entry.queries()[name], entry.oracle_sql()[name], SF01)
    assert res["status"] == "ok", res


def test_native_and_short_queries_have_their_columns(spark):
    for name, query in entry.queries().items():
        op = name.split("_")[0]
        if op in ("op4", "op5", "op6", "op9", "op10", "op13"):
            df = query(spark, SF001)
            assert COLUMNS[op] <= set(df.columns)
            plan = df._jdf.queryExecution().toString()
            if op in ("op4", "op10"):
                assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "InMap"))
