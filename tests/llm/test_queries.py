"""Registered corpus queries: against their SQL where there is one, and the contracts' columns."""

import pytest

from graphloom.llm import queries
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op3_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_near_dup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op10_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op11_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op12_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differs(spark, connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    own = dict(df.dtypes)
    assert {c: own.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    table = {"op4_url_filter": "pages", "op11_vector_codes": "embeddings"}.get(name, "documents")
    if name != "op12_lexical_search":
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_native_queries_run_no_python(spark):
    import io
    from contextlib import redirect_stdout

    for name in ("op4_url_filter", "op5_secret_scan"):
        out = io.StringIO()
        with redirect_stdout(out):
            queries.QUERIES[name](spark, SF).explain("formatted")
        assert not any(x in out.getvalue() for x in ("Python", "Arrow", "Pandas")), name
