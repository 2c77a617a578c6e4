"""Checks on residuals: leakage over block edges and autocorrelation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.dist import beta_tail, chi2_p_value
from foldwise.operators.hac import lag_products
from foldwise.operators.storage import CHUNK_ROWS, attach, beside, pinned


def edge_rows(resid: DataFrame, column: str, n_blocks: int, max_lag: int = 2, keys=(), controls=()) -> DataFrame:
    """Rows within ``max_lag`` of a block edge with their ``±1..±max_lag`` neighbours.

    Only rows near an edge are read past the filter, at most ``4 max_lag`` per
    block, so the window by key stays small however long the series is.
    """
    if max_lag < 1:
        raise ValueError(f"{max_lag} lags asked for; one is the least")
    keys, m = list(keys), max_lag
    size = F.greatest(F.floor(F.col("n_rows") / n_blocks), F.lit(1))
    inside, last = F.col("pos") % size, F.floor(F.col("n_rows") / size) * size
    near = (inside < 2 * m) | (inside >= size - 2 * m) | (F.col("pos") >= last - 2 * m)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("pos")
    rows = resid.where(F.col("block_id").isNotNull() & near)
    wide = rows.select(
        *keys, "pos", "n_rows", "block_id", F.col(column).alias("r"), *controls,
        *[F.lag(column, s).over(w).alias(f"lag{s}") for s in range(m, 0, -1)],
        *[F.lead(column, s).over(w).alias(f"lead{s}") for s in range(1, m + 1)])
    reaches = (inside < m) | (inside >= size - m)
    return wide.where(reaches & (F.col("pos") >= m) & (F.col("pos") < F.col("n_rows") - m)).drop("n_rows")


def joint_f(y: np.ndarray, tested: np.ndarray, others: np.ndarray) -> tuple:
    """F test that the coefficients of ``tested`` are all zero beside ``[1, others]``."""
    n, q = tested.shape
    k = q + others.shape[1] + 1
    if n <= k + 1:
        return None, None, n, 0
    small = np.column_stack([np.ones(n), others])
    big = np.column_stack([small, tested])

    def rss(x):
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return float(e @ e)

    free, bound = rss(big), rss(small)
    if free <= 0:
        return None, None, n, q
    f = max((bound - free) / q / (free / (n - k)), 0.0)
    return f, float(beta_tail((n - k) / (n - k + q * f), (n - k) / 2, q / 2)), n, q


def boundary_leakage(resid: DataFrame, column: str, n_blocks: int, max_lag: int = 2, keys=(), controls=()) -> DataFrame:
    """``keys, fold, F_stat, p_value, n_obs, df``; fold is a number or ``pooled``.

    A fold alone has too few edge rows for its own test, so its statistic is NULL;
    the pooled row is the result.
    """
    keys, m = list(keys), max_lag
    edges = edge_rows(resid, column, n_blocks, m, keys, controls)
    tested = [*[f"lag{s}" for s in range(m, 0, -1)], *[f"lead{s}" for s in range(1, m + 1)]]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").dropna(subset=tested)
        out = []
        for fold, part in [*pdf.groupby("block_id"), ("pooled", pdf)]:
            if len(part) < 2 * m + 3:
                if fold != "pooled":
                    out.append((str(fold), None, None, len(part), 0))
                continue
            out.append((str(fold), *joint_f(part["r"].to_numpy(float), part[tested].to_numpy(float),
                                            part[list(controls)].to_numpy(float).reshape(len(part), -1))))
        found = pd.DataFrame(out, columns=["fold", "F_stat", "p_value", "n_obs", "df"])
        for k in keys:
            found[k] = pdf[k].iloc[0] if len(pdf) else None
        return found

    types = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys],
                        "fold string, F_stat double, p_value double, n_obs bigint, df int"])
    by = keys or ["_all"]  # at most 2 max_lag rows per block in a group
    grouped = edges if keys else edges.withColumn("_all", F.lit(0))
    return grouped.groupBy(*by).applyInPandas(test, schema)


def ljung_box(resid: DataFrame, column: str, lags: int = 8, keys=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, lag, lb_stat, lb_pvalue`` for lags 1..``lags``."""
    keys = list(keys)
    rows = resid.where(F.col(column).isNotNull())
    stats = pinned(rows.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("_n"), F.avg(column).alias("_m")), keys)
    centred = attach(rows.select(*keys, "pos", column), stats, keys, chunk_rows=chunk_rows).select(
        *keys, "pos", (F.col(column) - F.col("_m")).alias("_e"))
    sums = lag_products(centred, ["_e"], lags, keys, chunk_rows)
    both = beside(sums, stats, keys)
    n, p = F.col("_n"), F.col("p_0_0")
    term = lambda k: F.pow(F.try_divide(p[k], p[0]), F.lit(2.0)) / F.greatest(n - k, F.lit(1))
    k = F.col("lag")
    each = both.select(*keys, "_n", "p_0_0", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"))
    total = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, j: s + term(j))
    out = each.where(k < n).select(*keys, "lag", (n * (n + 2) * total).alias("lb_stat"))
    return out.withColumn("lb_pvalue", chi2_p_value(F.col("lb_stat"), k))


def by_equation(resid: DataFrame, keys=(), horizon: int = 0) -> DataFrame:
    """Both residuals in one column ``r``, told apart by ``equation``."""
    pairs = F.explode(F.array(
        F.struct(F.lit("policy").alias("equation"), F.col("xi").alias("r")),
        F.struct(F.lit("outcome").alias("equation"), F.col(f"chi{horizon}").alias("r"))))
    return resid.select(*keys, "pos", "n_rows", "block_id", pairs.alias("_p")).select(
        *keys, "pos", "n_rows", "block_id", "_p.equation", "_p.r")


def diagnose(resid: DataFrame, n_blocks: int, max_lag: int = 2, lags: int = 8, keys=(),
             chunk_rows: int = CHUNK_ROWS) -> dict[str, DataFrame]:
    """Leakage and autocorrelation tests of both equations, one frame each."""
    tall = by_equation(resid, keys)
    by = [*keys, "equation"]
    return {"leakage": boundary_leakage(tall, "r", n_blocks, max_lag, by),
            "ljung_box": ljung_box(tall, "r", lags, by, chunk_rows)}
