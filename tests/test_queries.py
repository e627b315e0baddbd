"""Every registered query beside its SQL, on the smallest supplied scale."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, small_dir, name):
    ok, message = compare(spark, con, small_dir, name, QUERIES[name], CHECKS.get(name))
    assert ok, message
    assert "TYPES" not in message, message


def test_entry_runs(spark, small_dir):
    assert entry.entry(spark).count() > 0
