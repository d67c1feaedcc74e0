"""Every registered query against its SQL."""

import compare
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare.difference(df, duck, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_own_queries_have_sql():
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own <= set(entry.oracle_sql())
