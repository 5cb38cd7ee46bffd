"""Full-text search over an inverted index that is written once.

The index holds, for each term, the documents it is in, cut into zones: each zone is a
fixed share of all documents, so a row (term, zone) is a bounded list however
frequent the term. A row also keeps the largest weight any of its documents can give
the term. A search adds these up per zone, scores the most promising zones first, and
then only those that could still beat the last of the best found; it reads the rows of
its own terms and never a text. Ranking is BM25, exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.ordering import top

#: Saturation of repeated terms, and how much length counts.
K1, B = 1.2, 0.75
#: Documents of a zone, about.
ZONE = 1024
#: Folders that terms are dealt to; a search opens those of its terms.
BUCKETS = 64
#: Zones scored first, to know what the others have to beat.
FIRST_ZONES = 4


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass(frozen=True)
class TextIndex:
    """An index under ``root``, as :func:`build` writes it; the names are those of the documents' columns."""

    spark: SparkSession
    root: str
    id_col: str
    source: str = "source"
    category: str = "category"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _postings(self) -> DataFrame:
        """With its schema, as a table split by a column has no file where there are no rows."""
        kind = self._read("stats").schema["newest"].dataType.simpleString()
        return self.spark.read.schema(
            f"term string, zone bigint, source string, category string, most double, n bigint, "
            f"postings array<struct<id: {kind}, weight: double>>, bucket int").parquet(f"{self.root}/postings")

    def _terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df bigint, bucket int").parquet(f"{self.root}/terms")

    def search(self, query: str, *, source: str | None = None, category: str | None = None, limit: int = 10) -> DataFrame:
        """(id, source, category, score): the ``limit`` documents of the largest BM25 score, ties by id.

        Documents that hold none of the words are not found. Scores use the statistics
        of all documents, whatever the filters. The two filters and the terms reach the scan.
        """
        words = sorted({w for w in re.split(r"[^\w]|_", query.lower()) if w})
        if not words:
            raise ValueError("empty query")
        own = F.col("term").isin(words) & F.col("bucket").isin(*[_bucket(F.lit(w)) for w in words])
        rows = self._postings().filter(own)
        for name, value in (("source", source), ("category", category)):
            if value is not None:
                rows = rows.filter(F.col(name) == value)
        # One row for each word of the query.
        rows = rows.join(F.broadcast(self._terms().filter(own).select("term", "df")), "term")
        total = self._read("stats").select("documents").scalar()
        idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
        bounds = rows.groupBy("zone", "source", "category").agg(F.sum(idf * F.col("most")).alias("bound"))
        best = top(bounds, FIRST_ZONES, "-bound", "zone", "source", "category")
        # The limit-th best score of the first zones; with fewer documents than that anything may come in.
        found = top(self._scores(rows, idf, best), limit, "-score", self.id_col)
        beaten = found.agg(F.when(F.count(F.lit(1)) == limit, F.min("score")).otherwise(0.0).alias("score")).scalar()
        zones = bounds.filter(F.col("bound") * (1 + 1e-9) >= beaten)
        return top(self._scores(rows, idf, zones), limit, "-score", self.id_col).withColumnsRenamed(
            {"source": self.source, "category": self.category})

    def _scores(self, rows: DataFrame, idf: Column, zones: DataFrame) -> DataFrame:
        """Scores of the documents of ``zones``; terms are added in their order, so a score does not depend on partitions."""
        part = ("zone", "source", "category")       # the last two may be null
        own = zones.select(*[F.col(c).alias(f"_{c}") for c in part])
        kept = rows.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part], "left_semi")
        one = kept.select("term", "source", "category", idf.alias("idf"), F.explode("postings").alias("p"))
        parts = one.select("source", "category", F.col("p.id").alias(self.id_col), F.struct("term", (F.col("idf") * F.col("p.weight")).alias("w")).alias("part"))
        return parts.groupBy(self.id_col, "source", "category").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
            self.id_col, "source", "category", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p.w).alias("score"))


def build(docs: DataFrame, root: str, *, id_col: str, text: str, source: str = "source", category: str = "category") -> TextIndex:
    """Write the index of ``docs`` to ``root``.

    The texts are dealt to their zones once; there terms are counted per document, weighted
    by length and put into lists, and nothing larger than the texts is shuffled. How many documents
    a term is in comes from the lists, as a table of its own. A row of the index is the
    part of a term's list in one zone, source and category; its length is bounded by the zone, so
    a term in every document is spread over all tasks. Null texts are empty; ids are taken
    as unique.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(category).alias("category"),
                       F.coalesce(text, F.lit("")).alias("text"))
    length = F.size(tokens(F.col("text")))
    # The newest id gives the type of ids.
    rows.agg(F.count(F.lit(1)).alias("documents"), (F.sum(length) / F.count(F.lit(1))).alias("mean"), F.max("id").alias("newest")).write.mode(
        "overwrite").parquet(f"{root}/stats")
    stats = spark.read.parquet(f"{root}/stats")
    zones = F.greatest(F.lit(1), F.ceil(stats.select("documents").scalar() / ZONE))
    dealt = rows.withColumn("zone", F.pmod(F.xxhash64("id"), zones)).repartition("zone").withColumn("words", tokens(F.col("text")))
    # Both groupings are within a zone, so neither shuffles.
    counted = dealt.select("zone", "id", "source", "category", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy(
        "zone", "id", "source", "category", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = _weight(F.col("tf"), F.col("length"), stats.select("mean").scalar())
    posting = F.struct("id", weight.alias("weight"))
    lists = counted.groupBy("term", "zone", "source", "category").agg(
        F.max(weight).alias("most"), F.count(F.lit(1)).alias("n"), F.collect_list(posting).alias("postings"))
    lists.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{root}/postings")
    index = TextIndex(spark, root, id_col, source, category)
    df = index._postings().groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    df.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/terms")
    return index
