"""What the operators hand to Spark runs on executors that have no copy of the library."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.group import GroupedData

from tracewell.llm.queries import QUERIES

LOAD = """
import pickle, sys
from pyspark.core import broadcast
broadcast._from_id = lambda number: None        # only a task has the values
assert not any(m.startswith("tracewell") for m in sys.modules)
for f in pickle.load(sys.stdin.buffer):
    f = pickle.loads(f)
try:
    import tracewell
except ModuleNotFoundError:
    print("ok")
"""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_functions_unpickle_without_the_library(spark, tmp_path, monkeypatch, name):
    import pickle
    sent = []

    def recording(kind, method):
        plain = getattr(kind, method)

        def call(self, func, *args, **kwargs):
            sent.append(cloudpickle.dumps(func))
            return plain(self, func, *args, **kwargs)

        monkeypatch.setattr(kind, method, call)

    recording(DataFrame, "mapInArrow")
    recording(GroupedData, "applyInArrow")
    QUERIES[name](spark, "/root/testdata/sf0.001")
    out = subprocess.run([sys.executable, "-I", "-c", LOAD], input=pickle.dumps(sent), capture_output=True, cwd=tmp_path, timeout=120)
    assert out.stdout.strip() == b"ok", out.stderr.decode()[-800:]
