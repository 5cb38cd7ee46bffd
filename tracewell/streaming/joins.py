"""Interval containment between two streams."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.streaming.live import WATERMARK, event_time

# The function that lists the rows of a block travels by value, so workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Each size of block is 8 (2 ** BITS) of the size before, and the largest is at most a 16th of the longest interval.
BITS, BLOCKS = 3, 16
#: Entries of a list: what lies in a block beyond that is a further row, so no row grows with a crowded block. Spark
#: holds all pairs of a row at once when it makes them: the square of this, 65,536.
MOST = 256
#: Bytes of rows that a task lists at a time.
HELD_BYTES = 1 << 26
#: Added to the times that Spark's watermark sees: it starts at the epoch, and takes rows of that time or before for late.
EPOCH_S = 1 << 36


def stream_interval_join(points: DataFrame, intervals: DataFrame, *, at: str, start: str, end: str, longest_s: int,
                         watermark: str = WATERMARK, through: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs of a point and an interval ``[start, end]`` that contains it, both from streams; append mode.

    Times are epoch seconds. An interval is made up of aligned blocks of 1, 8, 64, .. seconds,
    the largest that fit; a point lies in one block of each size, and in exactly one of those
    of each interval around it. Size and block are the join key, so state and work are spread
    over the tasks and all that meets is a pair. Rows of a block that come at one time are
    one row of lists before the join: what the join keeps and gives out are lists of points
    and of intervals that all contain them, linear in the input while the pairs are not.

    Both watermarks bound the state: a point waits for intervals that may still begin before
    it, an interval for points up to ``longest_s`` after its start. An interval longer than
    that is an error, an open one (NULL end) contains what comes within ``longest_s``; a point
    or start of NULL matches nothing.

    ``through`` gets the lists of the join and returns them, as from a table that a stream has
    written: where the pairs outgrow every sink, they are made when they are read.
    """
    if longest_s < 4:
        raise ValueError("longest_s is at least 4 seconds")
    sizes = [0]
    while 1 << (sizes[-1] + BITS) <= longest_s // BLOCKS:
        sizes.append(sizes[-1] + BITS)
    p = points.filter(F.col(at).isNotNull()).withColumn("_last", F.floor(F.col(at)).cast("bigint"))
    p = p.withColumn("_key", F.explode(F.array(*[_block(k, F.shiftright("_last", k)) for k in sizes])))
    latest = F.col(start) + longest_s
    until = F.when(F.col(end) > latest, F.raise_error(F.lit("an interval is longer than longest_s")).cast("bigint")).otherwise(
        F.coalesce(F.col(end), latest))
    # Few tasks read a stream of few files; cutting the intervals is left to all.
    i = intervals.filter(F.col(start).isNotNull()).repartition(F.col(start)).withColumns({"_until": until, "_last": F.floor(F.col(start)).cast("bigint")})
    i = i.filter(F.col("_until") >= F.col(start)).withColumn("_to", F.floor(F.col("_until")).cast("bigint") + 1)
    i = i.withColumn("_key", F.explode(_cover(F.col("_last"), F.col("_to"), sizes)))
    p = event_time(_listed(p, points.schema, "_p"), "_last", watermark=watermark, alias="_at").drop("_last")
    i = event_time(_listed(i, intervals.schema, "_i"), "_last", watermark=watermark, alias="_start").drop("_last")
    # Holds for all that meets in a block: the newest point of a list follows the newest start.
    bound = F.expr(f"_at >= _start AND _at <= _start + INTERVAL {longest_s} SECONDS")
    own = p.withColumnsRenamed({"_size": "_psize", "_block": "_pblock"})
    met = own.join(i, (F.col("_psize") == F.col("_size")) & (F.col("_pblock") == F.col("_block")) & bound)
    met = met.drop("_psize", "_pblock", "_size", "_block", "_at", "_start")
    pairs = _unlisted(through(met) if through else met, points.columns, intervals.columns)
    whole = {"tinyint", "smallint", "int", "bigint"}
    if {dict(points.dtypes)[at], dict(intervals.dtypes)[start], dict(intervals.dtypes)[end]} <= whole:
        return pairs
    return pairs.filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.coalesce(F.col(end), latest)))


def _block(bits: int, number: Column) -> Column:
    return F.struct(F.lit(bits).alias("size"), number.alias("block"))


def _cover(first: Column, to: Column, sizes: list[int]) -> Column:
    """The blocks that make up the seconds from ``first`` to the one before ``to``, each the largest that fits."""
    def numbers(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    parts = []
    for k in sizes:
        inside = lambda bits: (F.shiftright(first + ((1 << bits) - 1), bits), F.shiftright(to, bits))
        a, b = inside(k)
        if k == sizes[-1]:
            left = numbers(a, b)
        else:       # without those in a block of the next size
            c, d = (F.shiftleft(x, BITS) for x in inside(k + BITS))
            left = F.when(c < d, F.concat(numbers(a, c), numbers(d, b))).otherwise(numbers(a, b))
        parts.append(F.transform(left, partial(_block, k)))
    return F.concat(*parts)


def _listed(rows: DataFrame, schema: T.StructType, prefix: str) -> DataFrame:
    """Rows of a block in lists, a column ``prefix`` and number for each of ``schema``; ``_last`` is the newest of their times."""
    cols = [F.col(f.name).alias(f"{prefix}{n}") for n, f in enumerate(schema.fields)]
    dealt = rows.select(F.col("_key.size").cast("bigint").alias("_size"), F.col("_key.block").alias("_block"),
                        (F.col("_last") + EPOCH_S).alias("_last"), *cols).repartition("_size", "_block")
    lists = [T.StructField(f"{prefix}{n}", T.ArrayType(f.dataType)) for n, f in enumerate(schema.fields)]
    return dealt.mapInArrow(_lists, T.StructType([*(T.StructField(c, T.LongType()) for c in ("_size", "_block", "_last")), *lists]))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= HELD_BYTES:
            yield _by_block(held)
            held, n = [], 0
    if sum(b.num_rows for b in held):
        yield _by_block(held)


def _by_block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).sort_by([("_size", "ascending"), ("_block", "ascending")])
    size, block, last = (t.column(c).to_numpy() for c in ("_size", "_block", "_last"))
    place = np.arange(len(size))
    first = np.maximum.accumulate(np.where(np.r_[True, (size[1:] != size[:-1]) | (block[1:] != block[:-1])], place, 0))
    cuts = np.flatnonzero((place - first) % MOST == 0)
    ends = pa.array(np.r_[cuts, len(size)], pa.int32())
    lists = {c: pa.ListArray.from_arrays(ends, t.column(c).combine_chunks()) for c in t.column_names[3:]}
    return pa.RecordBatch.from_pydict({"_size": size[cuts], "_block": block[cuts], "_last": np.maximum.reduceat(last, cuts), **lists})


def _unlisted(lists: DataFrame, points: list[str], intervals: list[str]) -> DataFrame:
    """The pairs of lists of points and intervals."""
    for prefix, cols in (("_p", points), ("_i", intervals)):
        each = lists.select("*", F.posexplode(f"{prefix}0").alias("_n", "_first"))
        others = {f"{prefix}{n}": F.get(F.col(f"{prefix}{n}"), F.col("_n")) for n in range(1, len(cols))}
        lists = each.withColumns({f"{prefix}0": F.col("_first"), **others}).drop("_n", "_first")
    names = [(f"_p{n}", c) for n, c in enumerate(points)] + [(f"_i{n}", c) for n, c in enumerate(intervals)]
    return lists.select(*[F.col(c).alias(name) for c, name in names])
