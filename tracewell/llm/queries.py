"""Registered queries of the operators: whole tables in, the digest columns of each contract out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (bpe, chat, classifier, copies, decontaminate, exact_dedup, fim, licenses, pii, quality_rules,
                           reputation, shallot, simhash)
from tracewell.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"


def hex_digest(parts: Column, sep: str) -> Column:
    return F.sha2(F.array_join(parts, sep), 256)


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    named = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    base = F.filter("pii.spans", lambda s: s.base)
    other = lambda kind: F.array_remove(F.transform(base, lambda s: s.kind), kind)
    counts = [(F.size(base) - F.size(other(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, hex_digest(named(base), ",").alias("base_sha256"),
                        F.array_join(named(F.col("pii.spans")), ",").alias("spans"),
                        F.size("pii.spans").cast("bigint").alias("n_spans"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "n_shared_words")


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                           "base_failed", "kept", "covered", "dup_line_chars")])


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotate(table(spark, sf_dir, "conversations"))
    return rows.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m.start, m.end)), ","))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op7_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("bigint"), lambda n, s: n + s.last_word - s.first_word + 1)
    return found.select("doc_id", "leak.n_words", n_hit.alias("n_hit"), F.size("leak.items").cast("bigint").alias("n_items"),
                        hex_digest(F.col("leak.items"), ",").alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), "text", public_tokenizers.path(RANKS),
                              public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select("doc_id", F.size("bpe.ids").cast("bigint").alias("n_tokens"),
                        hex_digest(F.col("bpe.ids").cast("array<string>"), " ").alias("ids_sha256"),
                        F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a folder for each source, in it one for each language."""
    files = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return licenses.scan(files, keep=("doc_id",))


def op11_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.decide(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.summary(*shallot.cluster(table(spark, sf_dir, "embeddings")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "fim.*")
    back = fim.restore(made, keep=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored.text", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_trees, op2_pii_transducers, op3_suffix_array_dedup, op4_repetition_rules, op5_perspective_rotation,
    op6_simhash_pivots, op7_benchmark_automaton, op8_byte_bpe, op9_host_reputation, op10_license_scan,
    op11_exact_copies, op12_shallot_clusters, op13_fill_in_middle)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_perspective_rotation": chat.SQL, "op9_host_reputation": reputation.SQL, "op11_exact_copies": copies.SQL,
    "op12_shallot_clusters": shallot.SQL, "op13_fill_in_middle": fim.SQL}
