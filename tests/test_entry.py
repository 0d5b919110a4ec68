"""The driver's entry points."""

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert "findings_summary" in queries and set(oracles) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
