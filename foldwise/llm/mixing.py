"""Mixing sources to target weights by repetition rates.

General records with a source and a text (for a panel of series: the key and its
notes): this library has no table with token counts.  Only Spark functions are
used.  Per row nothing but one join with the table of sources is needed; sizes are
summed per source before the shuffle, so a source with a third of all rows costs
no more than others.

Defined results: NULL text has size 0; a NULL source is a source of its own,
ordered last; rows with equal ids get equal copies; an empty table stays empty;
the decision about a row depends on its id and ``seed`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.tables import small_side
from foldwise.llm.words import WORD
from foldwise.operators.position import add_position
from foldwise.operators.storage import materialize


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source_col: str) -> Column:
    """Sorts by code point with NULL last, and joins NULL with NULL."""
    return F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets per source from ``sizes(key, size)``: ``key, source_size, target``.

    Each source gets ``min(most * size, level * weight)``, where the level makes the
    targets add up to ``share`` of all sizes: capped sources leave their excess to
    the others by weight.  The level is found by repeating that step; every round
    caps at least one more source and only sums reach the driver.
    """
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = add_position(totals.withColumnRenamed("key", "_rank_key"), "_rank_key")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(ranked.select(F.col("_rank_key").alias("key"), "source_size",
                                      F.get(turn, (F.col("pos") % len(weights)).cast("int")).alias("weight")))
    cap = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("full"), F.count(F.when(full, 1)).alias("n"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (share * (row["all"] or 0) - (row["full"] or 0.0)) / row["open"]
    return table.select("key", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _uniform(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1),
             share: float = 1.5, most: float = 2.0, seed: str = "mix", keep=()) -> DataFrame:
    """Per row ``id, size, source_size, target, copies, taken``, and the columns in ``keep``.

    Rate = target / source size.  A row is taken ``floor(rate)`` times, and once more
    if its hash falls below the fraction of the rate.
    """
    base = docs.select(F.col(id_col).alias("_id"), _key(source_col).alias("key"), n_words(text_col).alias("size"),
                       *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)])
    if not keep:
        base = materialize(base)  # sizes are counted once
    targets = materialize(source_targets(base.select("key", "size"), weights, share, most))
    joined = base.join(small_side(targets, 100_000), "key")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    copies = (F.floor("_rate") + (_uniform("_id", seed) < F.col("_rate") - F.floor("_rate")).cast("long")).cast("long")
    out = joined.withColumn("_rate", rate).withColumn("copies", copies)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
                      *[F.col(f"_keep_{i}") for i in range(len(keep))])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed rows, with all columns of the input; a row taken twice comes twice."""
    names = docs.columns
    plan = mix_plan(docs, id_col, text_col, source_col, keep=names, **how).where("copies > 0")
    many = plan.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return many.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(names)])
