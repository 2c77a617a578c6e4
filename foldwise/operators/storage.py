"""Shared-folder tables that cut lineage, and skew-safe lookups.

A result that two later branches read is written once as parquet below the
folder the session names in ``spark.checkpoint.dir``.  The files outlive lost
executors, later reads prune columns and push filters, and their size on disk is
the proven size Spark compares with ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one series that are handled as one group.  Every window and every
#: grouped task sees at most this many rows plus a short overlap.
CHUNK_ROWS = 32768


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="foldwise-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCOPES: ContextVar[tuple[list, ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foldwise/{uuid.uuid4().hex}"
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame | None) -> None:
    """Remove written tables (as ``materialize`` returned them) that nothing lazy reads any more."""
    for table in tables:
        if table is not None:
            _delete(table.sparkSession, table._folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps.

    They stay on the executors' disks until the driver's JVM collects the plans that made
    them, which a driver with a free heap may put off for long.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession):
    """Remove the tables that are written inside at the end.

    The value is a function that writes a result to last beyond the scope; whatever
    is lazy must be written by it before the scope ends.
    """
    paths: list[str] = []
    outer = _SCOPES.get()

    def kept(df: DataFrame) -> DataFrame:
        token = _SCOPES.set(outer)
        try:
            return materialize(df)
        finally:
            _SCOPES.reset(token)

    token = _SCOPES.set((*outer, paths))
    try:
        yield kept
    finally:
        _SCOPES.reset(token)
        for path in paths:
            _delete(spark, path)
        release(spark)


def pinned(groups: DataFrame, keys=()) -> DataFrame:
    """A small table computed once: one row without keys, written out with keys."""
    if keys:
        return materialize(groups)
    row = groups.first()
    return groups.sparkSession.createDataFrame([] if row is None else [row], groups.schema)


def chunk_of(pos: str = "pos", chunk_rows: int = CHUNK_ROWS):
    return F.floor(F.col(pos) / F.lit(chunk_rows))


def attach(rows: DataFrame, small: DataFrame, keys=(), extra=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add per-group constants of ``small`` to ``rows``.

    Without keys ``small`` is one row, whose values become literals, or one row
    per fold, which is broadcast.  With keys its size is unknown: Spark broadcasts
    it when its size allows, and otherwise shuffles on ``(keys, chunk)``, so that a
    series holding a third of all rows is still spread over many tasks.  ``small``
    then needs ``n_rows``, the length of its series.
    """
    keys, extra = list(keys), list(extra)
    if not keys:
        small = small.drop(*[c for c in ("n_rows",) if c in small.columns and c in rows.columns])
        if extra:
            return rows.join(F.broadcast(small), extra)  # one row per fold
        return rows.withColumns(literals(small))
    last = F.floor((F.col("n_rows") - 1) / F.lit(chunk_rows))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if "n_rows" in rows.columns:
        salted = salted.drop("n_rows")
    return (
        rows.withColumn("_salt", chunk_of(chunk_rows=chunk_rows))
        .join(salted, [*keys, *extra, "_salt"])
        .drop("_salt")
    )


def literals(small: DataFrame) -> dict:
    """The columns of a one-row table as literals."""
    row = small.first()
    return {f.name: F.lit(None if row is None else row[f.name]).cast(f.dataType) for f in small.schema.fields}


def beside(sums: DataFrame, groups: DataFrame, keys=()) -> DataFrame:
    """Two tables with one row per key, side by side; ``groups`` is the cheaper one."""
    return sums.join(groups, list(keys)) if keys else sums.withColumns(literals(groups))
