"""The driver's contract."""

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["id", "pubkey", "kind", "created_at"]
    assert rows.count() >= 0
