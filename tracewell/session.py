"""Spark session with the settings the operators assume."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution does the sizing: it merges small shuffle partitions, splits
#: skewed ones and turns a join into a broadcast once the real size is known.
SETTINGS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session of this one machine, as in tests, gets one of its own where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp()
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, when the session names a shared checkpoint folder.

    The result is a file in that folder, so later readers neither recompute it
    nor depend on the executors that made it. Without the setting ``df`` is
    returned as it is.
    """
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def build_session(app: str, *, master: str | None = None, shuffle_partitions: int | None = None,
                  extra: Mapping[str, str] | None = None) -> SparkSession:
    """A session with :data:`SETTINGS`.

    On a cluster give ``shuffle_partitions`` a few times the number of cores (or
    the input size divided by 128 MB when that is more); adaptive execution only
    ever merges partitions, it does not add any.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {**SETTINGS, **(extra or {})}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
