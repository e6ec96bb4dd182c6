"""The pN_ queries that have SQL on the smallest tables, against DuckDB; test_llm_brute_force has the others."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import assert_same, data, duck  # noqa: E402

from lexispark.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    folder = data()
    df = QUERIES[name](spark, folder)
    assert_same(df, duck(folder), SQL[name])


def test_found_columns(spark):
    folder = data()
    want = {
        "p1_found": [("sent_id", "bigint"), ("start_char", "int"), ("end_char", "int")],
        "p2_found": [("word_lo", "string"), ("word_hi", "string")],
        "p3_found": [("w1", "string"), ("w2", "string"), ("w3", "string")],
        "p4_found": [("vec_lo", "bigint"), ("vec_hi", "bigint")],
        "p5_found": [("kind", "string"), ("rec_id", "bigint"), ("term", "string")],
        "p6_found": [("kind", "string"), ("eval_split", "string"), ("source", "string"), ("id_lo", "bigint"), ("id_hi", "bigint")],
        "p7_found": [("field_name", "string"), ("form_lo", "string"), ("form_hi", "string")],
        "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p10_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, folder).dtypes == columns, name
