"""Every query with SQL agrees with it; the others give rows."""

import pytest
from check_oracles import compare, connect
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

ORACLES, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["value", "load", "extreme_tag", "abnormal_count", "original_index"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
