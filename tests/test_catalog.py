import pytest

from loomstead.plans.catalog import QUERIES

from oracle import DATA, same


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_duckdb(spark, name):
    same(QUERIES[name].run(spark, DATA), QUERIES[name].sql)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name].run(spark, DATA).count() > 0


def test_entry_module_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
