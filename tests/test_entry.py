"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 30


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "comments", "removed_bytes"]
    assert df.count() > 0
