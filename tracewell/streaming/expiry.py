"""Open sessions as state that expires.

The gauge of active sessions needs no row of a session that has ended: each session
is one number, its last event, and a time-out that fires when it has been silent for so
long that it counts as ended. What the stream gives out are the changes, a row when a
session opens, goes on or ends; the newest row of each session is the gauge's table.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.sinks.batches import STREAM_SPAN, BatchTable
from tracewell.streaming.live import WATERMARK, event_time

# The function on the state and the one in front of it travel by value, so workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("last_seen", T.LongType()),
                       T.StructField("open", T.BooleanType())])
LAST = T.StructType([T.StructField("at", T.LongType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _follow(silence_s: int) -> Callable:
    """Last event of a session, in seconds, and the one time-out that ends it ``silence_s`` later."""
    def changes(session: str, seen: int, opened: list[bool]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [session] * len(opened), "last_seen": [seen] * len(opened), "open": opened})

    def follow(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield changes(key[0], before, [False])
            return
        newest = max([int(r["last_seen"].max()) for r in rows] + [before] * (before is not None))
        # A time-out fires when the watermark has passed it, and a session ends when it has got there.
        ends = 1000 * (newest + silence_s) - 1
        over = ends < state.getCurrentWatermarkMs()
        if over:
            state.remove()
        else:
            state.update((newest,))
            state.setTimeoutTimestamp(ends)
        if over or newest != before:
            yield changes(key[0], newest, [True] * (newest != before) + [False] * over)

    return follow


def session_changes(stream: DataFrame, session: str, ts: str, silence_s: int, *, watermark: str = WATERMARK) -> DataFrame:
    """(session_id, last_seen, open): changes of the sessions in a stream of events; update mode.

    A session ends when the watermark has passed ``silence_s`` seconds after its last
    event, and its state goes; a later event opens it again. Before they meet the state,
    the events of each Arrow batch become one row for a session, so one that owns a
    third of all events is some rows in its task. Rows without a session or a time are
    left out. The state of a task's sessions goes to Python and back in Arrow batches. With
    RocksDB (:data:`ROCKSDB`) as the state store it need not fit the memory.
    """
    kind = dict(stream.dtypes)[ts]
    seconds = F.col(ts) if kind in ("bigint", "int") else F.unix_timestamp(F.col(ts).cast("timestamp"))
    rows = stream.select(F.col(session).cast("string").alias("session_id"), seconds.cast("bigint").alias("last_seen"))
    newest = rows.filter("session_id IS NOT NULL AND last_seen IS NOT NULL").mapInArrow(_newest, rows.schema)
    return event_time(newest, "last_seen", watermark=watermark).groupBy("session_id").applyInPandasWithState(
        _follow(silence_s), CHANGE, LAST, "update", GroupStateTimeout.EventTimeTimeout)


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        last = pa.Table.from_batches([b]).group_by("session_id").aggregate([("last_seen", "max")])
        yield from last.select(["session_id", "last_seen_max"]).rename_columns(["session_id", "last_seen"]).to_batches()


def gauge_table(spark, root: str) -> BatchTable:
    """The newest change of each session, written by one stream."""
    return BatchTable(spark, root, CHANGE, ["session_id"], span=STREAM_SPAN)


def keep_changes(table: BatchTable, query: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the changes of a batch. Of those of one session the last counts, and of
    an end and an opening at one time the end. The table reads a batch several times, the state is followed once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        cached = batch.withColumn("ended", ~F.col("open")).persist()
        try:
            table.write(cached, query, batch_id, order=("last_seen", "ended"))
        finally:
            cached.unpersist()

    return run
