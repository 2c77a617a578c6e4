"""Shared steps: bounded broadcasts and batches, links within nodes, connected components."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.storage import materialize, release

#: Rows up to which a table of a few numbers per row may be broadcast (some tens of MB).
BROADCAST_ROWS = 1_000_000

#: Bytes of the batches that texts and sets go to Python in.  Spark's own limit is 64 MB, which each of the JVM and the
#: worker hold several times for every task, outside the heap, and which their allocators keep for the life of an executor.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(step):
    """``step(docs, ...)``, by which all that it writes or counts meets Python in batches of ``BATCH_BYTES`` or a row at most.

    The session has its own limit again afterwards; plans that the step returns unwritten run under that one.
    """
    @wraps(step)
    def run(docs: DataFrame, *args, **how):
        spark = docs.sparkSession
        own = spark.conf.get(_BATCH)
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) <= BATCH_BYTES:
            return step(docs, *args, **how)
        spark.conf.set(_BATCH, str(BATCH_BYTES))
        try:
            return step(docs, *args, **how)
        finally:
            spark.conf.set(_BATCH, own)

    return run


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (written already) with a broadcast hint if its counted rows allow; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame, tidy: bool = False) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(item, root)`` per item, root the smallest item.

    Alternates two steps that hang every neighbour on the smallest item a node
    sees (larger neighbours, then smaller ones) until the edges stay the same, in
    about log of the diameter rounds.  Edges stay in shared tables throughout, of few
    files where they are few; the driver only sees their count and checksum.  ``tidy``
    lets go of the shuffle files of each round before the next one.
    """
    def stored(df: DataFrame) -> DataFrame:
        return materialize(df.coalesce(max(1, mark[0] // 200_000)) if mark[0] < 20_000_000 else df)

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                              F.col("m").alias("b"))
        now = stored(small.where("a <> b").distinct())
        if tidy:
            del both, least, large, down, joined, small
            release(edges.sparkSession)
    items = now.select(F.col("a").alias("item"), F.col("b").alias("root"))
    return stored(items.union(now.select("b", "b")).distinct())
