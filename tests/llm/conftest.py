import pytest


@pytest.fixture
def rows(spark):
    """rows(schema, *tuples) -> DataFrame."""
    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)
    return make
