"""Contiguous folds: which blocks train the nuisance learners of which fold.

A row belongs to a sample through its ``block_id``; no index lists exist.
Design ``rcf`` trains on one side of the main block, ``nlo`` on everything but
the main block and its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DESIGNS = ("rcf", "nlo")


def check_folds(n_blocks: int, design: str = "rcf", n_rows: int | None = None) -> None:
    if design not in DESIGNS:
        raise ValueError(f"unknown design {design!r}; known: {DESIGNS}")
    if n_blocks < (4 if design == "nlo" else 2):
        raise ValueError(f"design {design!r} needs more than {n_blocks} blocks")
    if n_rows is not None and n_rows // n_blocks < 2:
        raise ValueError(f"{n_rows} rows give blocks of fewer than 2 rows for {n_blocks} folds")


def direction_of(fold: Column, n_blocks: int) -> Column:
    half = n_blocks // 2
    central = (fold == half) if n_blocks % 2 else F.lit(False)
    return F.when(fold < half, "reverse").when(central, "both").otherwise("forward")


def fold_table(spark: SparkSession, n_blocks: int, design: str = "rcf") -> DataFrame:
    """``fold, direction, side``; one row per sample that trains a learner."""
    check_folds(n_blocks, design)
    folds = spark.range(n_blocks).select(F.col("id").cast("int").alias("fold"))
    if design == "nlo":
        return folds.select("fold", F.lit("buffered").alias("direction"), F.lit("buffered").alias("side"))
    way = direction_of(F.col("fold"), n_blocks)
    sides = F.when(way == "reverse", F.array(F.lit("right"))).when(way == "forward", F.array(F.lit("left")))
    return folds.select("fold", way.alias("direction"),
                        F.explode(sides.otherwise(F.array(F.lit("right"), F.lit("left")))).alias("side"))


def trains(block: Column, fold: Column, side: Column) -> Column:
    """Is ``block`` in the sample that trains ``(fold, side)``?"""
    return (
        F.when(side == "right", block > fold)
        .when(side == "left", block < fold)
        .otherwise(F.abs(block - fold) > 1)
    )


def neighbour(fold: Column, n_blocks: int) -> Column:
    """The block that validates the candidates of a fold."""
    return F.when(direction_of(fold, n_blocks) == "forward", fold - 1).otherwise(fold + 1)


def fold_membership(df: DataFrame, n_blocks: int, design: str = "rcf", columns=("pos",)) -> DataFrame:
    """One row per (fold, role, row).  Large by nature: rows times folds."""
    check_folds(n_blocks, design)
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    rows = df.where(F.col("block_id").isNotNull()).select(*columns, "block_id", folds.alias("fold"))
    gap = F.col("block_id") - F.col("fold")
    if design == "nlo":
        role = F.when(gap == 0, "main").when(F.abs(gap) > 1, "aux")
    else:
        role = F.when(gap == 0, "main").when(gap > 0, "aux_right").otherwise("aux_left")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).select(*columns, "fold", "role")


def sample_use_closed(k: Column, design: str) -> Column:
    """Share of rows that trains the learners, averaged over ``k`` folds."""
    if design == "nlo":
        return (k - 1) * (k - 2) / (k * k)
    return F.when(k % 2 == 0, (3 * k - 2) / (4 * k)).otherwise(3 * (k * k - 1) / (4 * k * k))


def sample_use(spark: SparkSession, first: int = 3, last: int = 15, digits: int = 4) -> DataFrame:
    k = F.col("K")
    rcf, nlo = sample_use_closed(k, "rcf"), sample_use_closed(k, "nlo")
    winner = F.when(F.abs(rcf - nlo) < 1e-12, "tie").when(rcf > nlo, "RCF").otherwise("NLO")
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("K")).select(
        "K", F.round(rcf, digits).alias("u_RCF"), F.round(nlo, digits).alias("u_NLO"), winner.alias("Winner"))


def measured_sample_use(df: DataFrame, n_blocks: int, design: str = "rcf", keys=()) -> DataFrame:
    """Rows that train each fold, from block counts; both sides count for a central fold."""
    keys = list(keys)
    counts = df.where(F.col("block_id").isNotNull()).groupBy(*keys, "block_id").agg(F.count(F.lit(1)).alias("n"))
    sides = F.broadcast(fold_table(df.sparkSession, n_blocks, design))  # at most K + 1 rows
    used = counts.join(sides, trains(F.col("block_id"), F.col("fold"), F.col("side")))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = counts.select(*keys, F.col("block_id").alias("fold"), F.sum("n").over(group).alias("n_all"))
    per_fold = used.groupBy(*keys, "fold").agg(F.sum("n").alias("n_train"))
    return per_fold.join(total, [*keys, "fold"]).select(
        *keys, "fold", "n_train", (F.col("n_train") / F.col("n_all")).alias("share"))
