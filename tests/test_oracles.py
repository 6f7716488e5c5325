import __spark_entry__ as entry
import pytest

from tests import oracle

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    cols, rows = oracle.spark_rows(QUERIES[name](spark, SF))
    expected_cols, expected = oracle.sql_rows(con, SQL[name])
    assert cols == expected_cols
    assert rows == expected


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL and not k.startswith("op") and k != "pipeline"))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query_and_the_entry_runs(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
