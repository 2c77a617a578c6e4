"""Block sums of products: all a linear learner needs to know about the rows.

Every training and validation sample is a union of whole blocks, so one scan
that sums ``z z'`` per block serves every fold, penalty and horizon.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.storage import CHUNK_ROWS, attach, materialize

#: Above this many product sums they are formed in numpy, a batch at a time.
MAX_SUM_COLUMNS = 150
#: Product sums a task may hold before it passes them on.
FLUSH_DOUBLES = 16_000_000
#: Products that travel in one row of the shuffle.
SLICE_DOUBLES = 64


def block_means(design: DataFrame, z_cols, keys=()) -> DataFrame:
    """``keys, block_id, n_rows, anchor``: the mean of every column in every block."""
    means = F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in z_cols])
    return design.where(F.col("block_id").isNotNull()).groupBy(*keys, "block_id").agg(
        F.max("n_rows").alias("n_rows"), means.alias("anchor"))


def block_gram(design: DataFrame, z_cols, keys=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, block_id, n_rows, anchor, g``; ``g`` is the upper triangle by rows of
    ``sum([1, z - anchor] [1, z - anchor]')`` with the block's own means as ``anchor``.

    Products are centred before they are added, so a level, or a step between
    blocks, costs no digits; ``learners.merged`` moves blocks to a common centre.
    """
    keys, z_cols = list(keys), list(z_cols)
    shift = materialize(block_means(design, z_cols, keys))
    rows = attach(design.where(F.col("block_id").isNotNull()).select(*keys, "pos", "n_rows", "block_id", *z_cols),
                  shift, keys, ["block_id"], chunk_rows=chunk_rows)
    z = [F.lit(1.0), *[F.col(c) - F.col("anchor")[i] for i, c in enumerate(z_cols)]]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    group = [*keys, "block_id"]
    if len(pairs) <= MAX_SUM_COLUMNS:
        named = rows.select(*group, *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        sums = named.groupBy(*group).agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_g{k}")
                                           for k, (i, j) in enumerate(pairs)])
        packed = sums.select(*group, F.array(*[F.col(f"_g{k}") for k in range(len(pairs))]).alias("g"))
    else:
        packed = _wide_sums(rows.select(*group, F.array(*z).alias("_z")), group, len(z))
    return materialize(packed.join(shift, group))


def _wide_sums(rows: DataFrame, group, width: int) -> DataFrame:
    upper = np.triu_indices(width)
    limit = max(1, FLUSH_DOUBLES // (width * width))

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            z = np.stack(pdf["_z"].to_numpy()) if len(pdf) else np.empty((0, width))
            for name, places in pdf.groupby(group, sort=False).indices.items():
                part = z[places]
                name = name if isinstance(name, tuple) else (name,)
                held[name] = held.get(name, 0.0) + part.T @ part
            if len(held) > limit:
                yield _frame(held)
                held = {}
        yield _frame(held)

    def _frame(held):
        out = pd.DataFrame(list(held), columns=group)
        out["v"] = [g[upper] for g in held.values()]
        return out

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in group], "v array<double>"])
    # Slices of the triangle are shuffled, not single products; a slice is added up element by element.
    cuts = list(range(0, len(upper[0]), SLICE_DOUBLES))
    pieces = F.array(*[F.struct(F.lit(k).alias("i"), F.slice("v", c + 1, SLICE_DOUBLES).alias("v")) for k, c in enumerate(cuts)])
    parts = rows.mapInPandas(partial, schema).select(*group, F.explode(pieces).alias("_s")).select(*group, "_s.i", "_s.v")
    sums = parts.groupBy(*group, "i").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"_v{j}") for j in range(SLICE_DOUBLES)])
    packed = F.filter(F.array(*[F.col(f"_v{j}") for j in range(SLICE_DOUBLES)]), lambda x: x.isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("i", packed.alias("v"))))
    return sums.groupBy(*group).agg(F.flatten(F.transform(ordered, lambda e: e["v"])).alias("g"))
