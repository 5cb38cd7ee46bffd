"""Gap-based streaks of uninterrupted activity.

Joining events whose gap is at most ``gap_s`` is a global, ordered operation.
It is made parallel in three steps, none of which sends a whole key or day
through one task:

1. events are counted per second, with map-side combine, so a day of one key
   holds at most 86,400 rows whatever its event volume;
2. islands are found inside (key, day) windows over those rows;
3. only the first and the last island of a day can touch a neighbouring day, so
   at most two rows per key and day go through the stitching window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.exprs import clock_of, day_of, duration_text, mean, rnd
from tracewell.functions.scoring import duration_bucket
from tracewell.operators.joins import interval_join
from tracewell.operators.ordering import top
from tracewell.operators.windows import rank_top

# Gap that still joins two events, and the shortest streak kept.
GAP_SECONDS = 30
MIN_SECONDS = 60
BUCKET_SECONDS = 86400


def _seconds(df: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    return df.filter(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_ts")).agg(F.count(F.lit(1)).alias("_n"))


def label_seconds(df: DataFrame, ts: str, *, gap_s: int = GAP_SECONDS, keys: Sequence[str] = (),
                  bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Every distinct second with events, its event count and the streak it lies in.

    Columns: keys, ``_ts``, ``_n``, ``start_ts``, ``end_ts``. A streak that spans
    several buckets has the same bounds in all of them.
    """
    if gap_s >= bucket_seconds:
        raise ValueError("gap_s must be smaller than bucket_seconds")
    seconds = _seconds(df, ts, keys).withColumn("_bucket", F.floor(F.col("_ts") / F.lit(bucket_seconds)))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_ts")
    opens = F.coalesce((F.col("_ts") - F.lag("_ts").over(w)) > gap_s, F.lit(True))
    numbered = seconds.withColumn("_open", opens.cast("int")).withColumn(
        "_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole, island = Window.partitionBy(*keys, "_bucket"), Window.partitionBy(*keys, "_bucket", "_island")
    bounded = numbered.select(
        *keys, "_ts", "_n", "_bucket", "_island", F.min("_ts").over(island).alias("_s"),
        F.max("_ts").over(island).alias("_e"), F.max("_island").over(whole).alias("_last"))

    # The first and the last island of each bucket: two rows per key and bucket.
    edge = (F.col("_island") == 1) | (F.col("_island") == F.col("_last"))
    edges = bounded.filter(edge & (F.col("_ts") == F.col("_s"))).select(*keys, "_bucket", "_island", "_s", "_e")
    chain = Window.partitionBy(*keys).orderBy("_s")
    joins = F.coalesce((F.col("_s") - F.lag("_e").over(chain)) > gap_s, F.lit(True))
    grouped = edges.withColumn("_o", joins.cast("int")).withColumn(
        "_g", F.sum("_o").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    streak = Window.partitionBy(*keys, "_g")
    stitched = grouped.select(*keys, "_bucket", "_island", F.min("_s").over(streak).alias("_ss"),
                              F.max("_e").over(streak).alias("_ee"))
    # One row per key and bucket: the join then uses the partitioning the seconds already have.
    first = F.col("_island") == 1
    ends = stitched.groupBy(*keys, "_bucket").agg(
        F.max(F.when(first, F.col("_ss"))).alias("_fs"), F.max(F.when(first, F.col("_ee"))).alias("_fe"),
        F.max(F.when(~first, F.col("_ss"))).alias("_ls"), F.max(F.when(~first, F.col("_ee"))).alias("_le"))
    at_end = F.col("_island") == F.col("_last")

    def bound(head: str, tail: str, own: str) -> Column:
        return F.when(first, F.col(head)).when(at_end, F.col(tail)).otherwise(F.col(own))

    return bounded.join(ends, [*keys, "_bucket"]).select(
        *keys, "_ts", "_n", bound("_fs", "_ls", "_s").alias("start_ts"), bound("_fe", "_le", "_e").alias("end_ts"))


def average_gap(duration: Column) -> Column:
    """Seconds between the ``tool_count`` events of a streak, on average."""
    return rnd(duration / F.greatest(F.col("tool_count") - 1, F.lit(1)), 2).alias("avg_gap_seconds")


def streaks_of(labelled: DataFrame, *, min_s: int = MIN_SECONDS, keys: Sequence[str] = ()) -> DataFrame:
    """Streak rows from labelled seconds, the short ones dropped."""
    duration = F.col("end_ts") - F.col("start_ts")
    sums = labelled.filter(duration >= min_s).groupBy(*keys, "start_ts", "end_ts").agg(F.sum("_n").alias("tool_count"))
    return sums.select(
        *keys, "start_ts", "end_ts", duration.alias("duration_seconds"), "tool_count",
        average_gap(duration))


def sessionize(df: DataFrame, ts: str, *, gap_s: int = GAP_SECONDS, min_s: int = MIN_SECONDS,
               keys: Sequence[str] = (), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Streaks of events at most ``gap_s`` apart (inclusive) lasting ``min_s`` or more."""
    labelled = label_seconds(df, ts, gap_s=gap_s, keys=keys, bucket_seconds=bucket_seconds)
    return streaks_of(labelled, min_s=min_s, keys=keys)


def frequencies_of(df: DataFrame, ts: str, values: Sequence[str], labelled: DataFrame, *,
                   min_s: int = MIN_SECONDS, keys: Sequence[str] = (), top_n: int = 10) -> DataFrame:
    """The ``top_n`` values of each column in ``values`` per streak: (field, value, n, rank).

    Values are counted per second before they meet the streaks, so the join
    carries a row per (second, value) and is spread over the seconds. All columns
    share one scan, one shuffle and one join.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).alias("value")) for v in values]))
    cells = df.select(*keys, F.col(ts).alias("_ts"), pairs.alias("_p")).select(*keys, "_ts", "_p.*").filter(
        F.col("value").isNotNull()).groupBy(*keys, "_ts", "field", "value").agg(F.count(F.lit(1)).alias("_c"))
    kept = labelled.filter(F.col("end_ts") - F.col("start_ts") >= min_s).select(*keys, "_ts", "start_ts")
    counts = cells.join(kept, [*keys, "_ts"]).groupBy(*keys, "start_ts", "field", "value").agg(F.sum("_c").alias("n"))
    w = Window.partitionBy(*keys, "start_ts", "field").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_n)


def streak_frequencies(df: DataFrame, ts: str, value: str, *, gap_s: int = GAP_SECONDS, min_s: int = MIN_SECONDS,
                       keys: Sequence[str] = (), top_n: int = 10) -> DataFrame:
    """The ``top_n`` values of one column per streak."""
    labelled = label_seconds(df, ts, gap_s=gap_s, keys=keys)
    freq = frequencies_of(df, ts, [value], labelled, min_s=min_s, keys=keys, top_n=top_n)
    return freq.select(*keys, "start_ts", F.col("value").alias(value), "n", "rank")


def autonomy_streaks(events: DataFrame, sessions: DataFrame | None = None, *, ts: str = "timestamp",
                     gap_s: int = GAP_SECONDS, min_s: int = MIN_SECONDS, enrich: int = 50,
                     materialize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The derived streak table: bounds, top projects, top tools, and, for the
    ``enrich`` longest streaks, up to five sessions open at the start.

    Several outputs read the labelled seconds. ``materialize`` (see
    :func:`tracewell.session.checkpointed`) computes them once.
    """
    labelled = label_seconds(events, ts, gap_s=gap_s)
    if materialize is not None:
        labelled = materialize(labelled)
    base = streaks_of(labelled, min_s=min_s)
    rows = events.select(ts, "tool_name", F.nullif(F.col("context"), F.lit("")).alias("context"))
    freq = frequencies_of(rows, ts, ["tool_name", "context"], labelled, min_s=min_s)

    # At most ten ranked values per streak and field.
    def ranked(field: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("field") == field, F.struct("rank", "value", "n"))))

    lists = freq.groupBy("start_ts").agg(
        F.transform(ranked("context"), lambda x: x["value"]).alias("projects"),
        F.map_from_entries(F.transform(ranked("tool_name"), lambda x: F.struct(x["value"], x["n"]))).alias("top_tools"))
    out = base.join(lists, "start_ts", "left")
    if sessions is None:
        return out.withColumn("session_ids", F.array().cast("array<string>"))
    ids = open_sessions(base, sessions, enrich).groupBy("start_ts").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("match_rank", "session_id"))), lambda x: x["session_id"])
        .alias("session_ids"))
    return out.join(ids, "start_ts", "left").withColumn(
        "session_ids", F.coalesce("session_ids", F.array().cast("array<string>")))


def open_sessions(streaks: DataFrame, sessions: DataFrame, n: int = 50) -> DataFrame:
    """Up to five sessions open at the start of each of the ``n`` longest streaks."""
    longest = top(streaks, n, "-duration_seconds", "start_ts").select("start_ts")
    s = sessions.select(F.col("id").alias("session_id"), "started_at", "ended_at")
    return interval_join(longest, s, at="start_ts", start="started_at", end="ended_at", order=[F.col("session_id")],
                         max_matches=5, point_limit=n).select("start_ts", "session_id", "match_rank")


def top_streaks(streaks: DataFrame, n: int = 10) -> DataFrame:
    """Longest streaks with rank (the record is rank 1) and display fields."""
    return rank_top(streaks, "duration_seconds", n, ["start_ts"]).select(
        "rank", F.col("duration_seconds").alias("duration"), duration_text("duration_seconds").alias("duration_text"),
        day_of("start_ts").alias("date"), F.substring(clock_of("start_ts"), 1, 5).alias("time"), "tool_count",
        F.col("avg_gap_seconds").alias("avg_gap"))


def streak_stats(streaks: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return streaks.agg(
        F.count(F.lit(1)).alias("total_streaks"), z("duration_seconds").alias("total_seconds"),
        z("tool_count").alias("total_tool_calls"),
        F.coalesce(rnd(mean("duration_seconds"), 0), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(rnd(mean("avg_gap_seconds"), 2), F.lit(0.0)).alias("avg_gap"))


def streak_daily(streaks: DataFrame, *, as_of: int, days: int = 30, tz: str = "UTC") -> DataFrame:
    recent = streaks.filter(F.col("start_ts") > as_of - days * 86400)
    return recent.groupBy(day_of("start_ts", tz).alias("date")).agg(
        F.max("duration_seconds").alias("longest"), F.count(F.lit(1)).alias("streaks"),
        F.sum("tool_count").alias("tools")).orderBy("date")


#: The duration buckets in display order.
DURATION_BUCKETS = ("<2m", "2-5m", "5-10m", "10-20m", "20-40m", "40m+")


def streak_histogram(streaks: DataFrame) -> DataFrame:
    """Streaks per duration bucket; empty buckets show 0."""
    t = streaks.select(duration_bucket("duration_seconds").alias("b")).agg(*[
        F.count_if(F.col("b") == b).alias(f"c{i}") for i, b in enumerate(DURATION_BUCKETS)])
    return t.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.col(f"c{i}").alias("n")) for i, b in enumerate(DURATION_BUCKETS)]))
        .alias("x")).select("x.*")


def autonomy_rate(events: DataFrame, streaks: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Percent of the observed span that lies inside streaks."""
    span = events.agg((F.max(ts) - F.min(ts)).alias("span"), F.lit(None).cast("bigint").alias("busy"))
    busy = streaks.agg(F.lit(None).cast("bigint").alias("span"), F.sum("duration_seconds").alias("busy"))
    both = span.unionByName(busy).agg(F.max("span").alias("span_seconds"),
                                      F.coalesce(F.max("busy"), F.lit(0)).alias("busy_seconds"))
    share: Column = rnd(F.col("busy_seconds").cast("double") / F.col("span_seconds") * 100, 1)
    return both.withColumn("autonomy_rate", F.when(F.col("span_seconds") > 0, share).otherwise(F.lit(0.0)))
