"""Memory store, knowledge tags, project portfolio and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import month_of
from tracewell.operators.filters import within_dates
from tracewell.operators.ordering import counter, top

KNOWLEDGE_TYPES = ("facts", "decisions", "patterns")


def _n() -> Column:
    return F.count(F.lit(1))


def store_totals(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(_n().alias("n")).select(F.lit(name).alias("store"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_project(items: DataFrame) -> DataFrame:
    return counter(items.filter(F.col("project").isNotNull()), "project", "project")


def by_source(items: DataFrame) -> DataFrame:
    return counter(items, "source", "source")


def by_category(learnings: DataFrame) -> DataFrame:
    return counter(learnings, "category", "category")


def daily_growth(rows: DataFrame, day: str, *, as_of: str, days: int = 30) -> DataFrame:
    return within_dates(rows, day, days, as_of=as_of).groupBy(F.substring(day, 1, 10).alias("date")).agg(
        _n().alias("n")).orderBy("date")


def review_queue(reviews: DataFrame, *, as_of: str) -> DataFrame:
    """Total, due and upcoming reviews per category; category ``*`` is the whole queue."""
    due = F.count_if(F.col("next_review") <= as_of)
    per = reviews.groupBy("category").agg(_n().alias("total"), due.alias("due"))
    whole = per.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("due"), F.lit(0)).alias("due"))
    both = per.unionByName(whole.select(F.lit("*").alias("category"), "total", "due"))
    return both.withColumn("upcoming", F.col("total") - F.col("due"))


def due_items(reviews: DataFrame, *, as_of: str, n: int = 10) -> DataFrame:
    return top(reviews.filter(F.col("next_review") <= as_of), n, "next_review", "id")


def recent_notes(learnings: DataFrame, n: int = 10) -> DataFrame:
    return top(learnings.select("id", "category", "project", "date"), n, "-date", "id")


def top_error_patterns(patterns: DataFrame, n: int = 8) -> DataFrame:
    return top(patterns, n, "-count", "category", "pattern")


def tag_counts(items: DataFrame, tags: Column, n: int = 12) -> DataFrame:
    """Top tags overall and by knowledge type, with the number of distinct tags."""
    t = items.select("type", F.explode(tags).alias("tag"))
    counts = t.groupBy("tag").agg(_n().alias("n"), *[F.count_if(F.col("type") == k).alias(k) for k in KNOWLEDGE_TYPES])
    unique = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return top(counts, n, "-n", "tag").withColumn("unique_tags", unique)


def monthly_growth(items: DataFrame) -> DataFrame:
    return items.filter(F.col("timestamp").isNotNull()).groupBy(month_of("timestamp").alias("month")).agg(
        *[F.count_if(F.col("type") == k).alias(k) for k in KNOWLEDGE_TYPES]).orderBy("month")


def portfolio(files: DataFrame) -> DataFrame:
    """Projects, files and lines over the whole portfolio."""
    return files.agg(F.count_distinct("project").alias("projects"), F.sum("files").alias("files"),
                     F.sum("lines").alias("lines"))


def file_types(projects: DataFrame, col: str) -> DataFrame:
    """Merge of the per-project maps {extension: files}: sum per extension."""
    return projects.select(F.explode(col).alias("ext", "n")).groupBy("ext").agg(F.sum("n").alias("files"))


def largest_projects(files: DataFrame, n: int = 10) -> DataFrame:
    sizes = files.groupBy("project").agg(F.sum("lines").alias("lines"))
    return top(sizes.filter(F.col("lines") > 0), n, "-lines", "project")


def pack_types(packs: DataFrame) -> DataFrame:
    return counter(packs, "type", "type")


def pattern_matrix(log: DataFrame, bucket: Column, patterns: Sequence[str], n: int) -> DataFrame:
    """Pattern counts per bucket for the newest ``n`` buckets, oldest first."""
    m = log.groupBy(bucket.alias("bucket")).agg(*[F.count_if(F.col("pattern") == p).alias(p) for p in patterns])
    return m.orderBy(F.col("bucket").desc()).limit(n).orderBy("bucket")


def search(docs: DataFrame, query: str, *, id_col: str, text: str, source: str = "all", category: str = "all",
           limit: int = 10) -> DataFrame:
    """Documents ranked by the share of distinct query words they contain.

    Filters reach the scan; scoring is one projection over whole texts and the
    cut is a bounded heap per task, so there is no shuffle of the documents.
    """
    hits = docs
    if source != "all":
        hits = hits.filter(F.col("source") == source)
    if category != "all":
        hits = hits.filter(F.col("category") == category)
    words = sorted(set(query.lower().split()))
    if not words:
        raise ValueError("empty query")
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    found = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])))
    scored = hits.select(id_col, "source", "category", (found / F.lit(float(len(words)))).alias("similarity"))
    scored = scored.filter(F.col("similarity") > 0)
    return top(scored, limit, "-similarity", id_col)


def hits_by_source(hits: DataFrame) -> DataFrame:
    return counter(hits, "source", "source")


def similar_vectors(vectors: DataFrame, query: Sequence[float] | Column, *, id_col: str, vec: str,
                    limit: int = 10) -> DataFrame:
    """The ``limit`` vectors most similar to ``query`` by cosine."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                           lambda s, x: s + x)

    v, probe = F.col(vec), F.col("_q")
    cos = F.try_divide(dot(v, probe), F.sqrt(dot(v, v)) * F.sqrt(dot(probe, probe)))
    return top(vectors.withColumn("_q", q).select(id_col, cos.alias("similarity")), limit, "-similarity", id_col)
