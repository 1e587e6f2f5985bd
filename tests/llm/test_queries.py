"""The subpackage's queries against their SQL, and their columns."""

import pytest

from loomgraph.llm import queries
from tests.conftest import same_rows

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_permutation": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_repetition": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_licences": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
}


@pytest.mark.parametrize("name", ORACLES)
def test_query(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck, ORACLES[name])


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(name, spark, sf):
    assert dict(QUERIES[name](spark, sf).dtypes) == COLUMNS[name]


def test_registered():
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
