"""Ratio of a series to its Hodrick-Prescott trend, in overlapping chunks.

The smoother weighs a row at distance ``j`` by about ``exp(-j / (sqrt(2)
lambda**0.25))``.  A chunk that also sees ``overlap_rows`` rows on each side
therefore gives the trend of the whole series to rounding error, and no task
holds a whole series.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.position import halo, reposition
from foldwise.operators.storage import materialize


#: Rows a task gathers to solve their chunks together.
STACK_ROWS = 262_144


def overlap_rows(smoothness: float) -> int:
    return math.ceil(40 * math.sqrt(2) * max(smoothness, 1.0) ** 0.25)


@lru_cache(maxsize=64)
def _factors(n: int, smoothness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots and the two lower diagonals of the factored system of ``n`` rows."""
    main = np.full(n, 6.0)
    main[[0, -1]] = 1.0
    main[[1, -2]] = 5.0
    if n == 4:
        main = np.array([1.0, 5.0, 5.0, 1.0])
    near = np.full(n - 1, -4.0)
    near[[0, -1]] = -2.0
    main, near, far = 1 + smoothness * main, smoothness * near, smoothness
    d, e, f = np.empty(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        d[i] = main[i]
        above = near[i] if i < n - 1 else 0.0
        if i >= 1:
            d[i] -= e[i - 1] ** 2 * d[i - 1]
            above -= e[i - 1] * f[i - 1] * d[i - 1]
        if i >= 2:
            d[i] -= f[i - 2] ** 2 * d[i - 2]
        e[i] = above / d[i]
        f[i] = far / d[i] if i < n - 2 else 0.0
    return d, e, f


def smooth_trend(x: np.ndarray, smoothness: float) -> np.ndarray:
    """Solve ``(I + smoothness * D'D) trend = x`` with ``D`` the second difference.

    ``x`` may hold many pieces of one length as rows: each step of the two sweeps
    is then done for all of them at once.
    """
    n = x.shape[-1]
    d, e, f = _factors(n, float(smoothness))
    t = np.array(x, dtype=float).T.copy()  # positions first
    for i in range(1, n):
        t[i] -= e[i - 1] * t[i - 1] + (f[i - 2] * t[i - 2] if i >= 2 else 0.0)
    t = (t.T / d).T
    for i in range(n - 2, -1, -1):
        t[i] -= e[i] * t[i + 1] + (f[i] * t[i + 2] if i < n - 2 else 0.0)
    return t.T


def trend_ratio(df: DataFrame, column: str, out: str, keys=(), smoothness: float = 14400.0,
                chunk_rows: int = 4096) -> DataFrame:
    """``keys, pos, out`` for the rows of ``df`` where ``column`` is given; needs 4 of them."""
    keys = list(keys)
    given = materialize(df.where(F.col(column).isNotNull()).select(*keys, "pos", F.col(column).cast("double").alias("_x")))
    numbered = reposition(given, keys).where("n_rows >= 4")
    overlap = overlap_rows(smoothness)
    pieces = halo(numbered, overlap, overlap, chunk_rows).select(*keys, "_chunk", "_home", "pos", "old_pos", "_x")

    group = [*keys, "_chunk"]

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        new = np.ones(len(pdf), dtype=bool)
        new[1:] = np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in group])
        starts = np.flatnonzero(new)
        sizes, x = np.diff(np.append(starts, len(pdf))), pdf["_x"].to_numpy(float)
        ratio, home = np.empty(len(pdf)), pdf["_home"].to_numpy(bool)
        own = np.logical_or.reduceat(home, starts)  # a chunk of copies only has no rows of its own
        for size in np.unique(sizes[own]):
            at = starts[own & (sizes == size)][:, None] + np.arange(size)
            ratio[at] = x[at] / smooth_trend(x[at], smoothness)
        kept = pdf.loc[home, [*keys, "old_pos"]].rename(columns={"old_pos": "pos"})
        kept[out] = ratio[home]
        return kept

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= STACK_ROWS:
                whole = pd.concat(held, ignore_index=True)
                last = np.logical_and.reduce([whole[c].to_numpy() == whole[c].iloc[-1] for c in group])
                cut = int(np.argmax(last))  # the last chunk may go on in the next batch
                if cut:
                    yield solved(whole.iloc[:cut].reset_index(drop=True))
                held, n = [whole.iloc[cut:]], len(whole) - cut
        if n:
            yield solved(pd.concat(held, ignore_index=True))

    fields = [f for f in pieces.schema.fields if f.name in keys]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "pos bigint", f"`{out}` double"])
    return pieces.repartition(*group).sortWithinPartitions(*group, "pos").mapInPandas(run, schema)
