"""Panel exports and log appends."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import canonical_hash
from tracewell.sources.jsonl import RAW, split_bad


def panel_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_panel(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    df.write.mode(mode).format(fmt).save(path)


def export_panels(panels: Mapping[str, DataFrame], root: str, names: list[str] | None = None) -> list[str]:
    """Write the named panels (or all of them), a directory of JSON lines each."""
    chosen = names or list(panels)
    unknown = [n for n in chosen if n not in panels]
    if unknown:
        raise ValueError(f"unknown panels: {unknown}")
    for n in chosen:
        write_panel(panels[n], f"{root}/{n}")
    return chosen


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def quarantine(lines: DataFrame, good_path: str, bad_path: str, text: str = RAW) -> DataFrame:
    """Write valid lines and bad lines to two new paths; returns the counts.

    The input is left alone, so it is its own backup.
    """
    spark = lines.sparkSession
    for rows, path in zip(split_bad(lines, text), (good_path, bad_path)):
        rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)
    # Counted from what was written: the texts are not parsed a third time.
    count = lambda path, name: spark.read.text(path).agg(F.count(F.lit(1)).alias(name))
    return count(good_path, "kept").withColumn("removed", count(bad_path, "removed").scalar())


Route = tuple[Callable[[DataFrame], DataFrame], str]


def fan_out(batch: DataFrame, routes: Mapping[str, Route], batch_id: int | None = None) -> None:
    """Write one batch to several differently shaped sinks.

    The batch is persisted once and read by every route. With a ``batch_id`` each
    sink gets its own directory per batch, overwritten on a retry, so replaying a
    batch does not duplicate rows.
    """
    cached = batch.persist()
    try:
        for shape, path in routes.values():
            out = shape(cached)
            if batch_id is None:
                out.write.mode("append").json(path)
            else:
                out.write.mode("overwrite").json(f"{path}/batch={batch_id}")
    finally:
        cached.unpersist()


def with_hash(panel: DataFrame, key: str) -> DataFrame:
    """Panel rows with a hash of all other columns."""
    return panel.withColumn("row_hash", canonical_hash([c for c in panel.columns if c != key]))


def changed_rows(panel: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """Rows whose hash differs from the last published one (new keys included)."""
    return with_hash(panel, key).join(last.select(key, "row_hash"), [key, "row_hash"], "left_anti")
