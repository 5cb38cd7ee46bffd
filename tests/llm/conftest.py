"""Fixtures of the operators' tests; their rows and helpers are in ``llm_rows``."""

import pytest
from llm_rows import ODD, SCHEMA


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, columns named like the operators' own."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
