"""Row positions and neighbours of ordered series, without one task per series.

``add_position`` range-partitions by ``(keys, time)``, so the rows of a long
series and of a burst in time are spread by sampled cut points.  ``halo`` copies
the few rows near the end of each chunk into its neighbour, so that a window by
``(keys, chunk)`` sees the same lags and leads as one over the whole series.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.storage import CHUNK_ROWS, attach, chunk_of, materialize, pinned


def add_position(df: DataFrame, time_col: str, keys=(), n_blocks: int | None = None) -> DataFrame:
    """Add ``pos`` (0-based, by time) and ``n_rows`` per key, and fold blocks on request."""
    keys = list(keys)
    order = [*keys, time_col]
    stored = materialize(
        _given(df, order).repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    pieces = stored.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # Without keys there is one piece per partition, which is safe to broadcast.
    out = _with_offsets(stored, pieces, keys, F.col("_seq") - F.col("_first"), bounded=not keys)
    out = out.drop("_part", "_seq", "_first", "_rows")
    return with_blocks(out, n_blocks) if n_blocks else out


def _given(df: DataFrame, columns) -> DataFrame:
    """Missing keys or times are an error: their rows have no place in any series."""
    missing = {c: F.raise_error(F.lit(f"missing values in {c!r}: rows without key or time have no place")) for c in columns}
    return df.withColumns({c: F.when(F.col(f"`{c}`").isNull(), e).otherwise(F.col(f"`{c}`")) for c, e in missing.items()})


def reposition(df: DataFrame, keys=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows left by a filter again; ``df`` should be materialized.

    The old position goes to ``old_pos``.
    """
    keys = list(keys)
    base = df.drop("n_rows").withColumnRenamed("pos", "old_pos").withColumn("_part", chunk_of("old_pos", chunk_rows))
    pieces = base.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("old_pos")) - 1
    numbered = base.withColumn("_inside", inside)
    return _with_offsets(numbered, pieces, keys, F.col("_inside")).drop("_part", "_inside", "_rows")


def _with_offsets(rows, pieces, keys, inside: Column, bounded: bool = False) -> DataFrame:
    # One row per key and part: running counts over this table only.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("n_rows", F.sum("_rows").over(group))
    )
    return (
        rows.join(F.broadcast(offsets) if bounded else offsets, [*keys, "_part"])
        .withColumn("pos", (F.col("_before") + inside).cast("long"))
        .drop("_before")
    )


def with_blocks(df: DataFrame, n_blocks: int) -> DataFrame:
    """``block_id`` of ``n_blocks`` equal blocks; NULL for the left-over tail."""
    size = F.floor(F.col("n_rows") / F.lit(n_blocks))  # 0 in a key that is too short: no blocks
    block = F.floor(F.try_divide(F.col("pos"), size)).cast("int")
    return df.withColumn("block_id", F.when(block < n_blocks, block))


def halo(df: DataFrame, before: int = 0, after: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_home``, with copies of rows that neighbours need."""
    size = max(chunk_rows, before, after)
    own = chunk_of(chunk_rows=size)
    inside = F.col("pos") % F.lit(size)
    copies = [own]
    if before:
        copies.append(F.when(inside >= size - before, own + 1))
    if after:
        copies.append(F.when((inside < after) & (F.col("pos") >= size), own - 1))
    target = F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull()))
    return df.withColumn("_chunk", target).withColumn("_home", F.col("_chunk") == own)


def chunk_window(keys=()) -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy("pos")


def ordered_select(df: DataFrame, columns, keys=(), before: int = 0, after: int = 0,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``select`` whose expressions may lag and lead over time.

    ``columns`` is a function from a window to the list of output columns.
    """
    wide = halo(df, before, after, chunk_rows)
    return wide.select(*columns(chunk_window(keys)), "_home").where("_home").drop("_home")


def check_times(df: DataFrame, time_col: str, keys=()) -> DataFrame:
    """Times that occur twice in a key, and missing times or keys: the order is then undefined."""
    return (
        df.groupBy(*keys, time_col).agg(F.count(F.lit(1)).alias("n_seen"))
        .where((F.col("n_seen") > 1) | reduce(or_, [F.col(c).isNull() for c in [*keys, time_col]]))
    )


def exact_quantiles(df: DataFrame, value: str, probs, keys=()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    Equal values are counted first, so a value that most rows share is one row of
    the sort; running counts over distinct values then give the two order
    statistics each quantile lies between.
    """
    keys = list(keys)
    order = [*keys, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    stored = materialize(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    pieces = stored.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value)) - F.col("_n")
    ranked = _with_offsets(stored.withColumn("_inside", inside), pieces, keys, F.col("_inside"), bounded=not keys)
    at = F.col("p") * (F.col("n_rows") - 1)
    last = F.col("pos") + F.col("_n") - 1
    holds = lambda place: ((place >= F.col("pos")) & (place <= last)).cast("double")
    share = at - F.floor(at)
    weight = (1 - share) * holds(F.floor(at)) + share * holds(F.floor(at) + 1)
    near = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("_w", weight).where("_w > 0")
    per_p = near.groupBy(*keys, "p").agg(F.sum(F.col(value) * F.col("_w")).alias("_q"))
    return per_p.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("_q"))).alias(f"q{round(100 * p):02d}") for p in probs]
    )


def calendar_gaps(df: DataFrame, time_col: str, keys=(), factor: float = 1.75,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Consecutive rows further apart than ``factor`` times the median step (days)."""
    keys = list(keys)
    step = F.floor((F.unix_micros(F.col(time_col).cast("timestamp"))
                    - F.unix_micros(F.lag(time_col).over(chunk_window(keys)).cast("timestamp"))) / 86_400_000_000)
    steps = materialize(
        ordered_select(
            df.where("n_rows >= 3"),
            lambda w: [*keys, "pos", "n_rows", F.lag(time_col).over(w).alias("gap_from"),
                       F.col(time_col).alias("gap_to"), step.cast("double").alias("step_days")],
            keys, before=1, chunk_rows=chunk_rows,
        ).where(F.col("gap_from").isNotNull())
    )
    typical = exact_quantiles(steps, "step_days", [0.5], keys).withColumnRenamed("q50", "median_days")
    if keys:
        lengths = steps.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"))
        typical = typical.join(lengths, keys)
    return attach(steps, pinned(typical, keys), keys, chunk_rows=chunk_rows).where(
        (F.col("median_days") > 0) & (F.col("step_days") > factor * F.col("median_days"))
    ).select(*keys, "gap_from", "gap_to", "step_days", "median_days")
