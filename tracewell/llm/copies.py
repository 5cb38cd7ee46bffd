"""Exact removal of equal texts by skew-safe combining.

Rows of equal text are combined three times, each time by the text itself and not
only by its digest: inside a task, before anything moves; then within (digest, salt),
where the salt is the task's number, so that the copies of a text that fills a third
of the table go to as many places as there are salts; and then, over one row for each
salt, within the digest. Back to the rows goes a key of digest and place: a text of
many copies names the places, of :data:`PLACES`, that its rows are dealt to, so no task
has to join all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import stored

#: Places that the rows of one text are dealt to: as many as a long has bits.
PLACES = 64


def sha256(text: Column) -> Column:
    """The default digest, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keyed(docs: DataFrame, doc_id: str, text: str, digest) -> DataFrame:
    """(doc_id, text, digest, place); a null text is empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("*", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).cast("int").alias("place"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, digest=sha256) -> DataFrame:
    """(digest, text, keep_id, group_size, places): a row for each different text of ``docs``.

    ``keep_id`` is the largest id of its rows, ``places`` has a bit for each place of
    :data:`PLACES` that one of its rows is dealt to. Null texts are empty texts; null
    ids are passed over unless a text has no other. Of an empty table there are none.
    """
    salts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
           F.bit_or(F.expr("shiftleft(1L, place)")).alias("places")]
    again = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.bit_or("places").alias("places")]
    # One salt for a task: its rows of one text become one row before they move.
    salted = _keyed(docs, doc_id, text, digest).withColumn("salt", F.spark_partition_id() % salts)
    winners = salted.groupBy("digest", "salt", "text").agg(*one)
    return winners.groupBy("digest", "text").agg(*again)


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): a row for each row of ``docs``, dropped ones too.

    Of equal texts the row with the largest id stays. Null texts count as empty and
    equal each other. Of rows that repeat an id and its text one stays; a null id
    stays only where its text has no other id. An empty table gives no rows, other
    columns are not read. Texts whose digests are equal though they differ keep
    apart: only digests of one text are joined by digest alone.
    """
    found = stored(groups(docs, doc_id, text, digest=digest).groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
        F.bit_or("places").alias("places")))
    rows = _keyed(docs, doc_id, text, digest)
    plain = _dealt(found.filter("texts = 1").drop("texts"))
    out = _kept(rows.drop("text").join(plain, ["digest", "place"]))
    if not found.filter("texts > 1").isEmpty():
        clashing = rows.join(found.filter("texts > 1").select("digest"), "digest", "left_semi")
        apart = _dealt(groups(clashing, digest=digest))
        out = out.union(_kept(clashing.join(apart, ["digest", "text", "place"])))
    return out


def _dealt(found: DataFrame) -> DataFrame:
    """A row of ``found`` for each place in ``places``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda k: F.getbit(F.col("places"), k) == 1)
    return found.withColumn("place", F.explode(bits)).drop("places")


def _kept(joined: DataFrame) -> DataFrame:
    """The winner's row is kept; rows that repeat its id and text are numbered, and the first stays."""
    same = joined.groupBy("digest", "place", "doc_id", "keep_id", "group_size").agg(F.count("*").alias("rows"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return same.withColumn("nth", F.explode(F.expr("sequence(1L, rows)"))).select(
        "doc_id", "keep_id", "group_size", (first & (F.col("nth") == 1)).alias("kept"), "digest")


#: DuckDB SQL of the query; a null text is empty.
SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
