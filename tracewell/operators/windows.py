"""Ordered analytics.

Windows run either on rollups (a row per day, hour or distinct value), which
are small whatever the event volume, or on time slices of a key, so that a hot
key or an unkeyed stream never has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordering import packed, rows_at

SLICE_SECONDS = 3600


def trailing_mean(daily: DataFrame, order: str, col: str, rows: int, *, strict: bool = False,
                  alias: str = "trailing") -> DataFrame:
    """Mean of the last ``rows`` rows of a rollup. NULLs are skipped.

    Partial frames count at the start; ``strict`` gives NULL there instead.
    """
    w = Window.orderBy(order).rowsBetween(-(rows - 1), 0)
    value = F.try_divide(F.sum(col).over(w), F.count(col).over(w).cast("double"))
    if strict:
        value = F.when(F.count(F.lit(1)).over(w) >= rows, value)
    return daily.withColumn(alias, value)


def last_rows_sum(daily: DataFrame, order: str, col: str, ks: Sequence[int]) -> DataFrame:
    """Sums over the newest ``k`` rows (rows, not calendar days)."""
    top = daily.select(order, col).orderBy(F.col(order).desc()).limit(max(ks))
    ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.col(order).desc())))
    return ranked.agg(*[
        F.coalesce(F.sum(F.when(F.col("_r") <= k, F.col(col))), F.lit(0.0)).alias(f"last_{k}") for k in ks])


def cumulative(daily: DataFrame, order: str, cols: Mapping[str, str]) -> DataFrame:
    """Running totals ``{column: new name}`` and the row number of a rollup."""
    w = Window.orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        order, F.row_number().over(w).cast("bigint").alias("row"),
        *[F.sum(c).over(run).alias(n) for c, n in cols.items()])


def period_over_period(daily: DataFrame, order: str, col: str, rows: int = 7) -> DataFrame:
    """Newest ``rows`` rows against the ``rows`` before them, in percent.

    NULL with no more than ``rows`` rows, or when the earlier sum is 0.
    """
    newest = daily.select(order, col).orderBy(F.col(order).desc()).limit(2 * rows)
    ranked = newest.withColumn("_r", F.row_number().over(Window.orderBy(F.col(order).desc())))
    agg = ranked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_r") <= rows, F.col(col))), F.lit(0)).alias("current"),
        F.coalesce(F.sum(F.when(F.col("_r") > rows, F.col(col))), F.lit(0)).alias("previous"))
    change = F.try_divide((F.col("current") - F.col("previous")) * F.lit(100.0), F.col("previous"))
    return agg.select("current", "previous", F.when(F.col("n_rows") > rows, change).alias("change_pct"))


def rank_top(df: DataFrame, by: str, n: int, ties: Sequence[str], alias: str = "rank") -> DataFrame:
    """Top ``n`` rows numbered from 1. The limit runs before the ranking window."""
    order = [F.col(by).desc(), *[F.col(t) for t in ties]]
    return df.orderBy(*order).limit(n).withColumn(alias, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def arg_max(df: DataFrame, by: str, take: Sequence[str], ties: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The row with the largest ``by`` (per group); ties go to the smallest ``ties``.

    With groups a hash aggregate finds the largest value of each and a join fetches
    its rows. Without, one aggregate takes one struct along, a row from each task; it has
    no key and so sorts nothing.
    """
    row = F.struct((-F.col(by)).alias("_o"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)],
                   *[F.col(c).alias(f"_v{i}") for i, c in enumerate(take)])
    known = df.filter(F.col(by).isNotNull())
    best = (rows_at(known, group, by, F.max) if group else known).groupBy(*group).agg(F.min(row).alias("_b"))
    best = best.filter(F.col("_b").isNotNull())
    return best.select(*group, *[F.col(f"_b._v{i}").alias(c) for i, c in enumerate(take)])


#: Widths of the blocks of ids of one key and instant. However ids are spread, dense or
#: hashed, a block of the first holds at most 2^20 rows and one of the second the ends of
#: 2^22 blocks; an instant holds the ends of 2^21.
ID_BLOCKS = (1 << 20, 1 << 42)


def consecutive_pairs(df: DataFrame, value: str, ts: str, tie: str, *, keys: Sequence[str] = (),
                      slice_seconds: int = SLICE_SECONDS, id_blocks: Sequence[int] = ID_BLOCKS,
                      gap: bool = False) -> DataFrame:
    """(previous, next) of neighbouring events within a key, in time order.

    Each key is cut into slices and ``lag`` runs inside a slice; the first and
    the last event of every slice, two rows however many events it holds, go on
    to the next, coarser level. The levels are (instant, block of ids) by growing
    width, then ``slice_seconds``, then the key. So a key, an hour or a single instant
    that owns a third of all events, or no key at all (``keys=()``), spreads out.
    ``tie`` must be a whole number for that; ``id_blocks=()`` skips the first levels
    and saves their shuffles where hours are known to be moderate.
    """
    rows = df.select(*keys, F.col(ts).alias("_ts"), F.col(tie).alias("_id"), F.col(value).alias("_v"),
                     F.lit(True).alias("_head"))
    hour = F.floor(F.col("_ts") / F.lit(slice_seconds))
    levels = [[hour], []]
    levels = [[F.col("_ts"), F.floor(F.col("_id") / F.lit(width))] for width in id_blocks] + levels
    parts = []
    for level in levels:
        w = Window.partitionBy(*keys, *level).orderBy("_ts", "_id")
        seen = rows.withColumns({"_pv": F.lag("_v").over(w), "_pts": F.lag("_ts").over(w),
                                 "_nts": F.lead("_ts").over(w)})
        # A row that heads its slice still lacks its predecessor; any other row has met it.
        found = seen.filter(F.col("_head") & F.col("_pts").isNotNull())
        parts.append(found.select(*keys, "_pv", "_v", "_pts", "_ts"))
        rows = seen.filter(F.col("_pts").isNull() | F.col("_nts").isNull()).select(
            *keys, "_ts", "_id", "_v", (F.col("_head") & F.col("_pts").isNull()).alias("_head"))
    pairs = reduce(DataFrame.unionByName, parts)
    out = [*keys, F.col("_pv").alias("previous"), F.col("_v").alias("next")]
    return pairs.select(*out, *([(F.col("_ts") - F.col("_pts")).alias("gap")] if gap else []))


def transitions(df: DataFrame, value: str, ts: str, tie: str, *, keys: Sequence[str] = (), top: int = 5,
                slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Transition counts and probabilities, the ``top`` successors per value."""
    pairs = consecutive_pairs(df, value, ts, tie, keys=keys, slice_seconds=slice_seconds)
    counts = pairs.groupBy("previous", "next").agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("previous")
    p = F.col("n").cast("double") / F.sum("n").over(per).cast("double")
    ranked = counts.withColumns({
        "probability": p,
        "rank": F.row_number().over(per.orderBy(F.col("n").desc(), "next")).cast("bigint")})
    return ranked.filter(F.col("rank") <= top)


#: What to prefetch before a tool runs.
PREFETCH = {"Read": "file_contents", "Grep": "search_index", "Edit": "file_contents",
            "Bash": "command_history", "WebFetch": "url_cache"}
PREFETCH_DEFAULT = "general"


def predict_next(trans: DataFrame, last: DataFrame, *, min_p: float = 0.1, top: int = 3) -> DataFrame:
    """Likely next tools for every key of ``last`` (its last tool in ``value``).

    ``trans`` has at most ``top`` successors per distinct tool, so it is small.
    """
    label = F.lit(None).cast("string")
    for tool, what in PREFETCH.items():
        label = F.coalesce(label, F.when(F.col("next") == tool, F.lit(what)))
    likely = trans.filter((F.col("probability") > min_p) & (F.col("rank") <= top))
    likely = likely.select("previous", "next", "probability", "rank",
                           F.coalesce(label, F.lit(PREFETCH_DEFAULT)).alias("prefetch"))
    return last.join(likely, last["value"] == likely["previous"]).drop("previous")


def lag_latency(df: DataFrame, ts_ms: str, tie: str, *, keys: Sequence[str] = (), lo: int = 0, hi: int = 5000,
                first_n: int | None = None, slice_ms: int = SLICE_SECONDS * 1000) -> DataFrame:
    """Milliseconds between consecutive events, kept strictly inside (lo, hi).

    ``first_n`` reads only the first events, as a tail-limited panel does.
    """
    if first_n is not None:
        df = df.orderBy(ts_ms, tie).limit(first_n)
    pairs = consecutive_pairs(df, tie, ts_ms, tie, keys=keys, slice_seconds=slice_ms, gap=True)
    return pairs.filter((F.col("gap") > lo) & (F.col("gap") < hi)).select(*keys, F.col("gap").alias("latency_ms"))


#: Distinct values that may be ordered in one task.
MAX_ORDERED_VALUES = 100_000
_BINS = 4096


def rank_percentile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Exact element at index ``floor(q * n)`` of the sorted values (no row when empty).

    The rank is located by refining a histogram: each round is one
    aggregate over at most 4096 bins, whose result narrows a literal range that
    reaches the scan as a filter, until few enough values are left to order. Bins
    with many equal values collapse in the count, so skew does not matter. The
    rounds run when the operator is called.
    """
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("_v"))
    before = 0
    n, lo, hi = values.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    if not n:
        return values.select(F.col("_v").alias("value"))
    rank = min(int(n * q), n - 1)
    size = n
    while size > MAX_ORDERED_VALUES and lo < hi:
        width = (float(hi) - float(lo)) / _BINS
        bin_ = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(width)), F.lit(_BINS - 1))
        inside = values.filter(F.col("_v").between(lo, hi))
        # One row per non-empty bin, at most _BINS of them.
        bins = inside.groupBy(bin_.alias("_b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).orderBy("_b").collect()
        for b in bins:
            if before + b.n > rank:
                break
            before += b.n
        if b.n == size:
            break
        size, lo, hi = b.n, b.lo, b.hi
    values = values.filter(F.col("_v").between(lo, hi))
    counts = values.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    target = F.lit(rank - before)
    located = counts.withColumns({"_end": F.sum("_n").over(upto), "_target": target})
    return located.filter((F.col("_end") > F.col("_target")) & (F.col("_end") - F.col("_n") <= F.col("_target"))).select(
        F.col("_v").alias("value"))


def section_lines(lines: DataFrame, order: str, text: str, marker: str, today: str, *, most: int | None = None,
                  fallback: int = 200) -> DataFrame:
    """Lines of the newest section headed by ``marker`` for ``today``, of these the last ``most``.

    A marker line opens a section; one that names ``today`` restarts the output
    and any other closes it. Only the position of today's last marker and of the
    next other marker are needed. Both are plain aggregates, found when this is called,
    so the log is never put in global order and the scan of the section has them as
    bounds that skip files and row groups. Without lines in a section the last
    ``fallback`` lines are returned.
    """
    t = F.trim(text)
    body = lines.filter(t != "").select(F.col(order).alias("_o"), t.alias("_t"))
    is_marker, names_today = F.col("_t").contains(marker), F.col("_t").contains(today)
    newest = lambda rows, n: (rows if n is None else rows.orderBy(F.col("_o").desc()).limit(n)).select(
        F.col("_o").alias(order), F.col("_t").alias(text))
    opened = body.filter(is_marker & names_today).agg(F.max("_o")).first()[0]
    if opened is not None:
        section = body.filter(F.col("_o") > opened)
        # After today's last marker, lines count until the first foreign marker.
        closed = section.filter(is_marker).agg(F.min("_o")).first()[0]
        if closed is not None:
            section = section.filter(F.col("_o") < closed)
        if not section.isEmpty():
            return newest(section, most)
    return newest(body, fallback)


def spread(daily: DataFrame, day: str, total: str, hours: DataFrame, hour: str, weight: str) -> DataFrame:
    """Day total spread over the hours by weight, each part truncated."""
    share = hours.select(hour, F.col(weight).alias("_w"), F.sum(weight).over(Window.partitionBy()).alias("_sum"))
    grid = daily.select(day, F.col(total).alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h"))
    return grid.join(share, F.col("_h") == F.col(hour)).select(
        day, F.col(hour), F.floor(F.col("_t") * F.col("_w") / F.greatest("_sum", F.lit(1))).alias("part"))


def first_value(df: DataFrame, key: str, text: str, order: Sequence[str], *, min_length: int = 4,
                cuts: Mapping[str, int]) -> DataFrame:
    """First text longer than ``min_length - 1`` per key, cut to several lengths.

    ``order`` is two whole numbers; of texts equal in both the smallest counts.
    """
    longest = max(cuts.values())   # no output is longer, so the aggregate carries no more
    usable = df.filter(F.length(text) >= min_length).select(key, packed(*order).alias("_at"), F.substring(text, 1, longest).alias("_h"))
    firsts = rows_at(usable, [key], "_at", F.min).groupBy(key).agg(F.min("_h").alias("_t"))
    return firsts.select(key, *[F.substring("_t", 1, n).alias(a) for a, n in cuts.items()])


def days_touched(df: DataFrame, day: str | Column) -> DataFrame:
    """Rows, distinct days and mean rows per touched day."""
    per_day = df.groupBy(F.col(day) if isinstance(day, str) else day).agg(F.count(F.lit(1)).alias("_n"))
    return per_day.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("days"),
        F.try_divide(F.coalesce(F.sum("_n"), F.lit(0)).cast("double"),
                     F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")).alias("per_day"))


def current_rank(ranked: DataFrame, hour: int, *, default_score: float = 0.5) -> DataFrame:
    """Rank and score of one hour in a short ranking, with defaults when absent.

    ``ranked`` is a top-k table (hour, score, rank).
    """
    agg = ranked.agg(
        F.count(F.lit(1)).alias("_k"),
        F.max(F.when(F.col("hour") == hour, F.col("rank"))).alias("_rank"),
        F.max(F.when(F.col("hour") == hour, F.col("score"))).alias("_score"),
        F.min_by("hour", "rank").alias("best_hour"), F.max("score").alias("best_score"))
    score = F.coalesce("_score", F.lit(default_score))
    best = F.coalesce("best_hour", F.lit(20))
    return agg.select(
        F.lit(hour).cast("bigint").alias("current_hour"),
        F.coalesce("_rank", F.col("_k") + 1).alias("current_rank"), score.alias("current_score"),
        best.alias("best_hour"), F.coalesce("best_score", F.lit(0.8)).alias("best_score"),
        F.when(score > 0.6, F.lit("Start now")).otherwise(
            F.concat(F.lit("Consider waiting until "), best.cast("string"), F.lit(":00"))).alias("recommendation"))
