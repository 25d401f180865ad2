"""Every registered query against its DuckDB counterpart, or at least for rows and a stable schema."""

import os

import pytest
from oracle import DATA, compare, connect

from lorekeep.plans.catalog import ORACLES, QUERIES

FOLDER = f"{DATA}/sf{os.environ.get('LOREKEEP_TEST_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0
        assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns == ["question_id", "hit_rank", "id", "title", "similarity", "metadata"]
    assert df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
