"""Tolerant JSON lines: bad lines are kept apart, never fatal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW, FILE = "_raw", "_file"


def is_json(text: Column | str) -> Column:
    """The text is one complete JSON value."""
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text).isNotNull()


def read_lines(spark: SparkSession, path: str | Sequence[str], *, recursive: bool = False,
               glob: str | None = None) -> DataFrame:
    """Lines of text files with the name of the file they came from."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        lines = reader.text(list(path) if not isinstance(path, str) else path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{RAW} string, {FILE} string")
    return lines.select(F.col("value").alias(RAW), F.col("_metadata.file_name").alias(FILE))


def parse_lines(lines: DataFrame, schema: T.StructType | str, *, text: str = RAW, keep_bad: bool = False) -> DataFrame:
    """Typed records from lines. Blank lines are skipped.

    With ``keep_bad`` unparseable lines stay, flagged in ``_bad``; else they are
    dropped. Works on batch and streaming frames alike.
    """
    rows = lines.filter(F.trim(text) != "").withColumn("_bad", ~is_json(text))
    if not keep_bad:
        rows = rows.filter(~F.col("_bad"))
    rec = rows.withColumn("_rec", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    return rec.select("_rec.*", *(["_bad", text] if keep_bad else []))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, *, keep_bad: bool = False) -> DataFrame:
    return parse_lines(read_lines(spark, path), schema, keep_bad=keep_bad)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON documents; no row when the file is missing or not JSON."""
    try:
        docs = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        docs = spark.createDataFrame([], "value string")
    good = docs.filter(is_json("value"))
    return good.select(F.from_json("value", schema).alias("_d")).select("_d.*")


def split_bad(lines: DataFrame, text: str = RAW) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid lines, blank lines dropped."""
    rows = lines.filter(F.trim(text) != "")
    good = is_json(text)
    return rows.filter(good), rows.filter(~good)
