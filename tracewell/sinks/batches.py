"""Keyed tables as folders of batches, merged when they are read.

A batch writes the rows of its own keys to a folder of its own and nothing else, so
its cost does not grow with the table; written again, it replaces that folder. Reading
merges the folders: counters by sums and maxima, rows by the largest batch number. A
periodic :meth:`BatchTable.fold` merges all batches below a number into one state, from
which readers go on; :meth:`BatchTable.retire` empties the folders it has made useless.
All of it is DataFrame reads and writes: there is no log and no file is ever changed.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.ordering import packed, rows_at
from tracewell.sinks.upserts import last_rows
from tracewell.sources.tables import read_table

NUMBER, SOURCE, SPAN, BELOW = "_number", "_source", "_span", "_below"
#: Numbers of one folder, which is retired as a whole: a day of clock numbers, so a small folder for a stream's.
SPAN_SIZE = 86_400_000_000
#: For tables whose numbers are those of a stream's batches.
STREAM_SPAN = 1000


def clock() -> int:
    """Number of a batch that none is given for: microseconds, so later batches win."""
    return time.time_ns() // 1000


class BatchTable:
    """A table under ``root`` with one row for each value of ``keys``.

    Columns ``add`` grow by each batch, columns ``latest`` keep the maximum; of the
    others the newest batch that has a value counts. Without ``add`` and ``latest`` the
    newest batch replaces the whole row. A batch is known by its number and its source:
    larger numbers are newer, and of equal ones one source wins, always the same.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], *,
                 add: Sequence[str] = (), latest: Sequence[str] = (), span: int = SPAN_SIZE):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, list(keys)
        self.add, self.latest, self.span = list(add), list(latest), span
        self._marked = T.StructType([*schema.fields, T.StructField(NUMBER, T.LongType()), T.StructField(SOURCE, T.StringType())])

    # ---- writes ------------------------------------------------------------
    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in self.schema.fields])

    def write(self, rows: DataFrame, source: str = "direct", number: int | None = None, order: Sequence[str] = ()) -> int:
        """Write one batch; returns its number.

        ``rows`` of counters are deltas, any number for a key; other tables take the
        last row of a key by ``order``, and several different ones without it are an
        error. A batch given again replaces itself; one below the last fold is part
        of it already and is not written. Without a number it is a new batch.
        """
        if not re.fullmatch(r"[\w.-]+", source):
            raise ValueError(f"letters, digits, dots and dashes only: {source!r}")
        number = clock() if number is None else number
        if number < self.folded():
            return number
        if self.add or self.latest:
            out = self._merged(self._typed(rows).withColumns({NUMBER: F.lit(number), SOURCE: F.lit(source)}))
        else:
            out = last_rows(rows, self.keys, order)
        self._typed(out).write.mode("overwrite").parquet(
            f"{self.root}/batches/{SPAN}={number // self.span}/{NUMBER}={number}/{SOURCE}={source}")
        return number

    def replace_all(self, rows: DataFrame, number: int | None = None) -> int:
        """Let ``rows`` be the table: all batches below ``number`` are left behind. One row for a key."""
        number = clock() if number is None else number
        marked = self._typed(rows).withColumns({NUMBER: F.lit(number - 1), SOURCE: F.lit("all")})
        return self._set(marked, number)

    def fold(self, below: int) -> int:
        """Merge all batches with numbers below ``below`` into one state; returns the number folded to.

        Take a number that no batch still being written lies below: for a stream one
        that it has gone past, for clock numbers some time that has passed.
        """
        if below <= self.folded():
            return self.folded()
        return self._set(self._state(below), below)

    def _set(self, state: DataFrame, below: int) -> int:
        state.select(*self._marked.names).write.mode("overwrite").parquet(f"{self.root}/folds/{BELOW}={below}")
        # Readers follow the mark, one small file that appears when the state is whole.
        self.spark.createDataFrame([(below,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marks/at={below}")
        return below

    def retire(self) -> list[int]:
        """Empty the folders of batches that lie below the last fold as a whole, and older folds; returns the spans emptied.

        Readers that planned before the fold may still need them: retire some time after it.
        """
        last = self.folded()
        spans = [r[0] for r in self._batches().filter(F.col(SPAN) < last // self.span).select(SPAN).distinct().collect()]
        old = [r[0] for r in self._folds().filter(F.col(BELOW) < last).select(BELOW).distinct().collect()]
        # Overwriting a folder with no rows, split by a column, leaves it without files.
        none = self.spark.createDataFrame([], "n long, p long").write.mode("overwrite").partitionBy("p")
        for path in [*[f"batches/{SPAN}={k}" for k in spans], *[f"folds/{BELOW}={k}" for k in old]]:
            none.parquet(f"{self.root}/{path}")
        return sorted(spans)

    # ---- reads -------------------------------------------------------------
    def _batches(self) -> DataFrame:
        # The names of the folders are columns; they come last, in the order of the path.
        fields = [*self.schema.fields, T.StructField(SPAN, T.LongType()), *self._marked.fields[-2:]]
        return read_table(self.spark, f"{self.root}/batches", T.StructType(fields))

    def _folds(self) -> DataFrame:
        return read_table(self.spark, f"{self.root}/folds", T.StructType([*self._marked.fields, T.StructField(BELOW, T.LongType())]))

    def folded(self) -> int:
        """All batches with numbers below this are in the state last folded."""
        marks = read_table(self.spark, f"{self.root}/marks", T.StructType([T.StructField("n", T.LongType())]))
        most = marks.agg(F.max("n")).first()[0]
        return -(1 << 62) if most is None else most

    def _state(self, below: int | None = None) -> DataFrame:
        """One row for each key, with the number and source it is from."""
        last = self.folded()
        newer = self._batches().filter((F.col(NUMBER) >= last) & (F.col(SPAN) >= last // self.span))
        if below is not None:
            newer = newer.filter((F.col(NUMBER) < below) & (F.col(SPAN) <= below // self.span))
        folded = self._folds().filter(F.col(BELOW) == last)
        return self._merged(folded.select(*self._marked.names).unionByName(newer.select(*self._marked.names)))

    def read(self, below: int | None = None) -> DataFrame:
        """The table; with ``below`` as the batches before that number made it, if they are not folded with later ones."""
        return self._state(below).select(*self.schema.names)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """Merge rows of several batches; all states have fixed width, so this is a hash aggregate with map-side combine."""
        at = _age(F.col(NUMBER), F.col(SOURCE))
        if self.add or self.latest:
            rest = [c for c in self.schema.names if c not in {*self.keys, *self.add, *self.latest}]
            return rows.groupBy(*self.keys).agg(
                *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in self.add], *[F.max(c).alias(c) for c in self.latest],
                *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest],
                F.max(NUMBER).alias(NUMBER), F.lit("fold").alias(SOURCE)).select(*self._marked.names)
        return rows_at(rows.withColumn("_at", at), self.keys, "_at", F.max).select(*self._marked.names)


def _age(number: Column, source: Column) -> Column:
    """Batch number, then a hash of the source, as one number of fixed width."""
    return packed(number, F.xxhash64(source))
