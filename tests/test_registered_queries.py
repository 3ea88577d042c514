import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    if name in ORACLE:
        assert compare(spark, con, small, QUERIES[name], ORACLE[name]) == ""
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["level"] for r in rows} == {"Critical", "High", "Medium", "Low"}
    assert len(rows) == 4 and sum(r["n"] for r in rows) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
