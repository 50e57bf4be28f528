"""Every core query against its SQL on the smallest data; queries without SQL must at least run and keep their columns."""

from pathlib import Path

import pytest

from splitwright.plans.registry import ORACLES, QUERIES
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
