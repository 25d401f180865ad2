import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorekeep.session import local_session  # noqa: E402
from lorekeep.streaming.history import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluates a column expression over literal rows and returns its values in order."""
    from pyspark.sql import functions as F

    def run(rows, schema, column):
        numbered = [(i, *row) for i, row in enumerate(rows)]
        df = spark.createDataFrame(numbered, "_i int, " + schema)
        return [r[0] for r in df.select(column.alias("v"), "_i").orderBy(F.col("_i")).select("v").collect()]

    return run
