"""Each query over a given table: against its SQL, or for its rows and columns."""

import os

import pytest
from oracle import DATA, compare, connect

from lorekeep.llm.queries import ORACLES, QUERIES

FOLDER = f"{DATA}/sf{os.environ.get('LOREKEEP_TEST_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, connect(FOLDER), ORACLES[name]) == []
    else:
        assert df.count() > 0
        assert len(set(df.columns)) == len(df.columns)
