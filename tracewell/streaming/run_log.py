"""Health of the streams: a table with a row for each batch, from what Spark reports of it."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from tracewell.sources.tables import read_table

METRIC = "run_log"
SCHEMA = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("at", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("newest", T.LongType()), T.StructField("lag_seconds", T.LongType()),
    T.StructField("duration_ms", T.LongType()), T.StructField("state_rows", T.LongType())])


def observed(stream: DataFrame, ts: str) -> DataFrame:
    """``stream`` with its rows and newest time (epoch seconds) measured in passing."""
    return stream.observe(METRIC, F.count(F.lit(1)).alias("rows"), F.max(ts).alias("newest"))


class RunLog(StreamingQueryListener):
    """Keeps what each batch of the named queries reports, and appends it to the table at ``path``.

    Rows are written every ``every`` batches and when a query ends; the driver holds so many
    at most. Add it with ``spark.streams.addListener``. Queries without a name are left out,
    and so are triggers without a batch.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every, self.rows, self.ended = spark, path, every, [], set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.name:
            return
        seen = p.observedMetrics.get(METRIC)
        rows, newest = (seen["rows"], seen["newest"]) if seen is not None else (p.numInputRows, None)
        report = json.loads(p.json)
        at = report["timestamp"]
        now = int(time.mktime(time.strptime(at[:19], "%Y-%m-%dT%H:%M:%S")) - time.timezone)
        self.rows.append((p.name, p.batchId, at, rows, newest, None if newest is None else now - newest,
                          report.get("durationMs", {}).get("triggerExecution"),
                          sum(s.get("numRowsTotal", 0) for s in report.get("stateOperators", []))))
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self.ended.add(str(event.id))

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def wait(self, query_id: str, seconds: int = 60) -> bool:
        """Whether the report of the query's end has come; reports arrive some time after it."""
        until = time.time() + seconds
        while str(query_id) not in self.ended and time.time() < until:
            time.sleep(0.1)
        return str(query_id) in self.ended


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SCHEMA)


def health(log: DataFrame, *, slow_ms: int = 60_000, late_s: int = 3600) -> DataFrame:
    """(query, batches, empty, rows, slow, late, longest_ms): one row for each stream."""
    return log.groupBy("query").agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.col("rows") == 0).alias("empty"), F.sum("rows").alias("rows"),
        F.count_if(F.col("duration_ms") > slow_ms).alias("slow"), F.count_if(F.col("lag_seconds") > late_s).alias("late"),
        F.max("duration_ms").alias("longest_ms"))
