import os

import pytest

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture
def sf_dir():
    return SF


@pytest.fixture
def frame(spark):
    """A small table from rows and a schema, dealt over three partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
