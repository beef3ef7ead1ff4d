import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def frame(spark):
    """Build a small frame; an extra column clashes with what operators add."""

    def make(rows, schema, extra=None):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.lit(v) for c, v in (extra or {}).items()})

    return make
