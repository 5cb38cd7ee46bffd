"""Session and fixtures; helpers are in ``rows``."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from rows import seeded  # noqa: E402
from tracewell.schemas import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def store(spark):
    """The seeded telemetry store of the fixtures."""
    return seeded(spark)


@pytest.fixture(scope="session")
def empty_store(spark):
    return {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
