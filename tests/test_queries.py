"""Every core query that has SQL on the smallest tables, against DuckDB; test_brute_force has the others."""

import pytest
from conftest import assert_same, data, duck

from lexispark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    folder = data()
    df = QUERIES[name](spark, folder)
    assert_same(df, duck(folder), SQL[name])


def test_entry(spark):
    import __spark_entry__

    data()
    df = __spark_entry__.entry(spark)
    assert df.columns == ["w1", "w2", "bigram_count", "pmi"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
