"""Chat formatting by perspective rotation.

A dialogue of several speakers is rendered once for each of them: that speaker is the
assistant, every other one a user with a name, and only the assistant's own words and
their end marks are to be trained on. Long dialogues come in parts of a bounded number
of turns, which follow each other without a gap or an overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed

#: Turns in a part.
PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = ("system",)
KEYS = ("conv_id", "turn", "speaker", "text")


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, speaker, text) with ``seq``: 0, 1, .. within a conversation by turn, speaker, text.

    Nothing is sorted in one task: equal rows become one row with a count, rows are
    range-partitioned by the whole order, so a conversation may span many partitions,
    and numbers are sums of counts, within a partition and over the partitions before.
    """
    counted = turns.groupBy(*KEYS).agg(F.count("*").alias("copies"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS).withColumns(
        {"place": F.monotonically_increasing_id(), "slice": F.spark_partition_id()})
    ranged = checkpointed(ranged)      # a number must not change when a task runs again
    sums = ranged.groupBy("conv_id", "slice").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"),
                       F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("last", F.sum("copies").over(inside))
    joined = own.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")))
    end = F.col("before") + F.col("last") - 1
    return joined.select(*KEYS, F.explode(F.sequence(end - F.col("copies") + 1, end)).alias("seq"))


def rotate(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role",
           text: str = "text", system: Sequence[str] = SYSTEM, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, first_turn, n_turns, text, masks), parts of every dialogue for every participant.

    A turn reads ``<|im_start|>role[ name=speaker]``, a line end, its text, ``<|im_end|>``
    and a line end. ``masks`` has the (start, end) character ranges of ``text`` to train
    on: the assistant's words with their end mark. Turns of ``system`` speakers keep the
    role system in every perspective and have none of their own.

    Turns stand by turn number, then speaker, then text, nulls first; repeated rows are
    turns as often as they occur. A turn without a speaker is a user without a name. A
    null text is empty. A null conv_id is a conversation too. One with system turns
    only, and an empty table, give nothing.
    """
    turns = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).alias("speaker"),
                                 F.coalesce(F.col(text), F.lit("")).alias("text"))
    who = turns.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system)).select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = numbered(turns).join(who, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = (F.when(F.col("speaker").isin(*system), "system").when(own, "assistant").when(F.col("speaker").isNull(), "user")
            .otherwise(F.concat(F.lit("user name="), F.col("speaker"))))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    shown = F.struct("seq", F.concat(head, "text", F.lit(CLOSE + "\n")).alias("shown"), own.alias("own"),
                     F.length(head).alias("head"))
    grouped = seen.groupBy("conv_id", "perspective", F.floor(F.col("seq") / part).alias("part")).agg(
        F.sort_array(F.collect_list(shown)).alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))
    masks = F.aggregate("turns", zero, lambda acc, t: F.struct(
        (acc.at + F.length(t.shown)).alias("at"),
        F.when(t.own, F.concat(acc.masks, F.array(F.struct((acc.at + t.head).alias("start"), (acc.at + F.length(t.shown) - 1).alias("end")))))
        .otherwise(acc.masks).alias("masks")), lambda acc: acc.masks)
    return grouped.select("conv_id", "perspective", "part", F.expr("turns[0].seq").alias("first_turn"),
                          F.size("turns").cast("bigint").alias("n_turns"),
                          F.array_join(F.transform("turns", lambda t: t.shown), "").alias("text"), masks.alias("masks"))


SQL = f"""
WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS seq,
  coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
shown AS (SELECT conv_id, perspective, seq // {PART} AS part, seq, coalesce(role = perspective, false) AS own,
  '{OPEN}' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' WHEN role IS NULL THEN 'user'
  ELSE 'user name=' || role END || chr(10) AS head, text || '{CLOSE}' || chr(10) AS body
  FROM t JOIN who ON conv_id IS NOT DISTINCT FROM c),
placed AS (SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM shown)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(min(seq) AS BIGINT) AS first_turn, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY seq) AS text,
  coalesce(string_agg(CAST(CAST(off + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(off + length(head || body) - 1 AS BIGINT) AS VARCHAR), ','
    ORDER BY seq) FILTER (WHERE own), '') AS masks
FROM placed GROUP BY conv_id, perspective, part"""
