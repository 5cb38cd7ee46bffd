"""Joins: outcome fan-out, child counts, lookups, intervals, calendar fill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.exprs import mean, pct



def attach_outcomes(sessions: DataFrame, outcomes: DataFrame, *, dedupe: bool = False) -> DataFrame:
    """Left join of sessions to their outcome events.

    A session repeats once per event, as the panels expect. The join is written
    as an inner join plus the sessions without events: Spark can split a hot
    session on either side of an inner join (adaptive skew join) and may broadcast
    a small session side, neither of which a left join allows here.
    ``dedupe=True`` averages the events of a session first, so each session stays
    one row and the shuffle carries one row per session instead of one per event.
    ``quality`` and ``complexity`` come from the events.
    """
    sessions = sessions.drop("quality", "complexity")
    o = outcomes.select(
        F.col("session_id").alias("_sid"), F.col("quality_score").alias("quality"), "complexity")
    if dedupe:
        o = o.groupBy("_sid").agg(mean("quality").alias("quality"), mean("complexity").alias("complexity"))
        return sessions.join(o, F.col("id") == F.col("_sid"), "left").drop("_sid")
    matched = sessions.join(o, F.col("id") == F.col("_sid")).drop("_sid")
    bare = sessions.join(o.select("_sid").distinct(), F.col("id") == F.col("_sid"), "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def child_counts(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows of each child table per parent.

    Every child is counted by key before it is joined, so no product of two
    children is ever formed and map-side combine absorbs hot parents.
    """
    out = parent
    for name, (child, fk) in children.items():
        counts = child.groupBy(F.col(fk).alias(f"_{name}")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in children})


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, cols: Mapping[str, str]) -> DataFrame:
    """Left lookup of dimension columns (``{source: new name}``).

    No hint is given: a dimension that grows with the data must not be forced
    into a broadcast. Spark broadcasts it when its size statistics allow.
    """
    d = dim.select(F.col(dim_key).alias("_dk"), *[F.col(c).alias(n) for c, n in cols.items()])
    return df.join(d, F.col(key) == F.col("_dk"), "left").drop("_dk")


def lookup_or_default(df: DataFrame, key: str, dim: Mapping[str, Mapping[str, float]], default: str) -> DataFrame:
    """Lookup in a small fixed mapping; unknown keys use the default row.

    The mapping is job configuration of a few entries, so it becomes a literal
    ``CASE`` and needs no join at all.
    """
    fields = list(dim[default])
    out = {}
    for f in fields:
        expr: Column | None = None
        for name, row in dim.items():
            cond = F.col(key) == name
            expr = F.when(cond, F.lit(row[f])) if expr is None else expr.when(cond, F.lit(row[f]))
        out[f] = expr.otherwise(F.lit(dim[default][f]))
    return df.withColumns(out)


def due_soon(interactions: DataFrame, contacts: DataFrame, days: int = 7, *, as_of: str) -> DataFrame:
    """Follow-ups due within ``days``, with the contact they belong to."""
    horizon = F.date_add(F.lit(as_of).cast("date"), days).cast("string")
    due = interactions.filter(F.col("follow_up").isNotNull() & (F.col("follow_up_date") <= horizon))
    c = contacts.select(F.col("id").alias("_cid"), "name", "company")
    return due.join(c, F.col("contact_id") == F.col("_cid")).select(
        "name", "company", "follow_up", "follow_up_date", "type")


def _first_k(df: DataFrame, per: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group. Spark cuts to ``k`` in every task before the shuffle too."""
    w = Window.partitionBy(*per).orderBy(*order)
    ranked = df.withColumn("match_rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("match_rank") <= k)


#: Bounds and points lie between -FAR and FAR; an open interval ends at FAR.
FAR = 1 << 62


def interval_join(points: DataFrame, intervals: DataFrame, *, at: str, start: str, end: str,
                  order: Sequence[Column], max_matches: int = 5, point_limit: int | None = None) -> DataFrame:
    """The first ``max_matches`` intervals ``[start, end]`` by ``order`` that contain each point.

    Bounds are whole numbers within :data:`FAR`, others are an error; an ``end`` of
    NULL is open, and an interval or point of NULL matches nothing.

    Each interval is cut into aligned blocks of size 1, 2, 4, ..: at most two per
    size, whatever its length. A block is a join key, and a point lies in exactly one
    block of every interval that contains it. Only the first ``max_matches``
    intervals of a block can win at any of its points, so the rest are cut before the
    join: the pairs of a crowded stretch are never formed. Points look only at the
    block sizes that occur.

    ``point_limit`` says that there are at most so many points; they are then sent to
    every task and the intervals stream past them once, without a shuffle. More
    points than that are an error, so both ways give the same rows.
    """
    far = F.lit(FAR).cast("bigint")

    def within(c: Column) -> Column:
        ok = (c >= -far) & (c <= far)
        return F.when(c.isNull() | ok, c).otherwise(F.raise_error(F.lit("a bound or point is out of range")).cast("bigint"))

    if point_limit is not None:
        few = points.limit(point_limit + 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
        few = few.withColumn(at, F.when(F.col("_n") <= point_limit, within(F.col(at))).otherwise(
            F.raise_error(F.lit("more points than point_limit")).cast(points.schema[at].dataType))).drop("_n")
        covers = (within(F.col(start)) <= F.col(at)) & (F.col(end).isNull() | (within(F.col(end)) >= F.col(at)))
        return _first_k(intervals.join(F.broadcast(few), covers), [at], order, max_matches)

    def bits(f: str, c: Column) -> Column:
        return F.call_function(f, c, F.col("_level"))

    cut = intervals.withColumns({"_a": within(F.col(start)), "_b": F.coalesce(within(F.col(end)), far - 1) + 1}).filter(
        F.col("_a") < F.col("_b"))
    # Intervals with the same bounds contain the same points: the first of them are all that can win, before blocks multiply them.
    cut = _first_k(cut, ["_a", "_b"], order, max_matches).drop("match_rank")
    # Block sizes that fit the length, and one more since log2 is inexact.
    length = F.col("_b").cast("double") - F.col("_a").cast("double")
    fitting = F.sequence(F.lit(0), F.least(F.lit(61), F.floor(F.log2(length)).cast("int") + 1))
    sized = cut.withColumn("_level", F.explode(fitting))
    size = bits("shiftleft", F.lit(1).cast("bigint"))
    sized = sized.withColumns({"_l": bits("shiftright", F.col("_a") + (size - 1)), "_r": bits("shiftright", F.col("_b"))})
    fits, odd = F.col("_l") < F.col("_r"), lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    # At the last size blocks are not paired any further: all that fit are listed, eight at most.
    last = F.col("_level") == 61
    ends = F.when(last & fits, F.sequence(F.col("_l"), F.col("_r") - 1)).otherwise(F.array_compact(
        F.array(F.when(fits & odd("_l"), F.col("_l")), F.when(fits & odd("_r"), F.col("_r") - 1))))
    blocks = sized.withColumn("_block", F.explode(ends)).drop("_a", "_b", "_l", "_r")
    blocks = _first_k(blocks, ["_level", "_block"], order, max_matches).drop("match_rank")
    sizes = blocks.agg(F.collect_set("_level").alias("s")).scalar()
    spots = points.withColumn("_level", F.explode(sizes)).withColumn("_block", bits("shiftright", within(F.col(at))))
    return _first_k(spots.join(blocks, ["_level", "_block"]).drop("_level", "_block"), [at], order, max_matches)


def calendar_fill(daily: DataFrame, day: str, measures: Sequence[str], *, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """One row per calendar day from ``start`` (or the first day) to ``end``.

    ``daily`` is a rollup with a row per day; the spine is as long as the period,
    so both sides are small whatever the volume of events behind them.
    """
    lo = F.lit(start).cast("date") if start else F.min(F.col(day).cast("date"))
    hi = F.lit(end).cast("date") if end else F.max(F.col(day).cast("date"))
    spine = daily.agg(lo.alias("_a"), hi.alias("_b")).filter(F.col("_a") <= F.col("_b")).select(
        F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("_d")).select(
        F.col("_d").cast("string").alias(day))
    return spine.join(daily.select(day, *measures), day, "left").select(
        day, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def preserve_existing(new: DataFrame, stored: DataFrame, key: str, col: str) -> DataFrame:
    """Stored value when there is one, else the newly computed value."""
    kept = stored.filter(F.col(col).isNotNull() & (F.col(col) != 0)).select(key, F.col(col).alias("_kept"))
    return new.join(kept, key, "left").withColumn(col, F.coalesce("_kept", col)).drop("_kept")


def prefer_nonzero(a: Column | str, b: Column | str, guard: Column) -> Column:
    """``a``, or ``b`` when ``a`` is missing or zero and ``guard`` holds."""
    a = F.coalesce(F.col(a) if isinstance(a, str) else a, F.lit(0.0))
    b = F.col(b) if isinstance(b, str) else b
    return F.when((a == 0) & guard, b).otherwise(a)


def share_of(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count of each value and its percentage of the group total.

    The window runs over the grouped counts, so a hot group has been reduced to
    one row per value before it is shuffled.
    """
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.select(group, value, "n", pct(F.col("n"), total).alias("pct"))


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group, ties kept, with its share."""
    w = Window.partitionBy(group).orderBy(F.col("n").desc())
    return share_of(df, group, value).withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1).drop("_r")


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """One value per group: the most frequent, ties by smallest value."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def matrix(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Row by column count matrix; absent cells are 0."""
    cells = [F.count_if(F.col(col) == v).alias(v.replace("-", "_")) for v in values]
    return df.groupBy(row).agg(*cells)
