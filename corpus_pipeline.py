"""From raw documents to token ids: rules, near-duplicates, benchmark leaks, personal data, tokens.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns
of ``documents``, whatever they are named, for the rows that stay. Null and empty
texts fail the quality rules; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, pii, quality_rules, simhash
from tracewell.llm.common import fresh, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the repetition rules."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id."""
    return simhash.one_per_group(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    name = fresh(docs, "leak")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.filter(F.size(f"{name}.spans") == 0).drop(name)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by ``[KIND]``; ``n_chars`` is counted anew."""
    out = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their token ids (``ids``), the ids' number and whether they decode to the text."""
    name = fresh(docs, "bpe")
    coded = bpe.encode_decode(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, name=name)
    same = F.col(f"{name}.decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(*docs.columns, F.size(f"{name}.ids").cast("bigint").alias(fresh(docs, "n_tokens")),
                        F.col(f"{name}.ids").alias(fresh(docs, "ids")), same.alias(fresh(docs, "round_trip")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", leaks), ("pii", private), ("byte_bpe", tokens)]

#: SQL cannot express the tokens, nor the components of the near-duplicates.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
