"""Impulse responses: one effect per horizon from shared residuals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.crossfit import by_horizon
from foldwise.operators.stage2 import stage2, stage2_horizons
from foldwise.operators.storage import CHUNK_ROWS
from foldwise.plans.spec import Inference

# How the code of the outcome turns residuals into a cumulative response.
SUM_CODES = (2, 3, 5, 7, 9)
SUM_OVER_12_CODES = (8, 10)
SUM_OVER_4_CODES = (81, 101)
SUM_AND_LAST_OVER_12_CODES = (12,)


def cumulated(current: Column, running: Column, code: Column) -> Column:
    """``running`` is the sum over horizons up to and including ``current``."""
    return (
        F.when(code.isin(*SUM_CODES), running)
        .when(code.isin(*SUM_OVER_12_CODES), running / 12)
        .when(code.isin(*SUM_OVER_4_CODES), running / 4)
        .when(code.isin(*SUM_AND_LAST_OVER_12_CODES), (running + current) / 12)
        .otherwise(current)
    )


def cumulate(resid: DataFrame, code: int | str | None = None) -> DataFrame:
    """Residual table whose ``chi0..chiH`` follow the outcome code.

    ``code`` is a number, or the name of a column that gives it by key.  All
    horizons of a row are side by side, so nothing is shuffled.
    """
    if code is None:
        return resid
    which = F.col(code) if isinstance(code, str) else F.lit(int(code))
    chis = sorted([c for c in resid.columns if c.startswith("chi") and c[3:].isdigit()], key=lambda c: int(c[3:]))
    new, running = {}, None
    for c in chis:
        running = F.col(c) if running is None else running + F.col(c)
        new[c] = cumulated(F.col(c), running, which)
    return resid.select([new[c].alias(c) if c in new else F.col(c) for c in resid.columns])


def irf_columns(effects: DataFrame, keys=()) -> DataFrame:
    """The nine columns of an impulse response, from stage-two rows by ``h``."""
    coef, se = F.col("coef"), F.col("std_error")
    return effects.select(
        *keys, F.col("h").cast("int").alias("Horizon"), coef.alias("Coefficient"), se.alias("Std_Error"), "t_stat",
        "p_value", F.col("ci_lower").alias("CI_Lower_95"), F.col("ci_upper").alias("CI_Upper_95"),
        (coef - 1.645 * se).alias("CI_Lower_90"), (coef + 1.645 * se).alias("CI_Upper_90"))


def local_projections(resid: DataFrame, spec: Inference = Inference(), code: int | str | None = None, keys=(),
                      time_col: str = "ts", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Impulse response from cross-fitted residuals of every lead.

    Under the rule ``small`` horizon ``h`` uses the bandwidth ``h + 1``.  All horizons of a row
    stay side by side where ``stage2_horizons`` allows it.
    """
    keys, spec, resid = list(keys), replace(spec, se="stacked_hac"), cumulate(resid, code)
    effects = stage2_horizons(resid, spec, keys, chunk_rows)
    if effects is None:  # one row per position and horizon
        effects = stage2(by_horizon(resid, keys, time_col), spec, [*keys, "h"], chunk_rows)
    return irf_columns(effects, keys)


def residual_table(resid: DataFrame, keys=(), time_col: str = "ts") -> DataFrame:
    """Policy residual and outcome residual per horizon, by time."""
    chis = [c for c in resid.columns if c.startswith("chi") and c[3:].isdigit()]
    return resid.select(*keys, time_col, F.col("xi").alias("treatment_resid"),
                        *[F.col(c).alias(f"outcome_resid_h{c[3:]}") for c in chis])


def scale_irfs(irfs: DataFrame, numerator: str, denominator: str, basis_point=(), target: float = 0.5,
               name_col: str = "outcome", keys=()) -> DataFrame:
    """Responses per common shock: the impact gap of two outcomes becomes ``target``.

    A missing outcome or an impact gap of zero leaves NULL responses in a panel;
    for a single system both are errors.
    """
    keys = list(keys)
    impact = irfs.where(F.col("Horizon") == 0)
    pick = lambda who: F.max(F.when(F.col(name_col) == who, F.col("Coefficient")))
    gaps = impact.groupBy(*keys).agg(pick(numerator).alias("_num"), pick(denominator).alias("_den"))
    gap = F.col("_num") - F.col("_den")
    factor = gaps.select(*keys, F.when(F.abs(gap) >= 1e-12, F.lit(float(target)) / gap).alias("_factor"))
    if not keys:
        found = gaps.first()
        if found["_num"] is None or found["_den"] is None:
            raise KeyError(f"responses of {numerator!r} and {denominator!r} are both needed")
        if abs(found["_num"] - found["_den"]) < 1e-12:
            raise ValueError("the two impact responses are equal")
        known = irfs.withColumn("_factor", F.lit(float(target) / (found["_num"] - found["_den"])))
    else:
        known = irfs.join(factor, keys)
    times = F.col("_factor") * F.when(F.col(name_col).isin(*basis_point), 100.0).otherwise(1.0) if basis_point else F.col("_factor")
    new = {"Coefficient": F.col("Coefficient") * times, "Std_Error": F.col("Std_Error") * F.abs(times)}
    for level in (95, 90):  # a negative factor turns an interval around
        low, high = F.col(f"CI_Lower_{level}") * times, F.col(f"CI_Upper_{level}") * times
        new[f"CI_Lower_{level}"], new[f"CI_Upper_{level}"] = F.least(low, high), F.greatest(low, high)
    return known.select([new[c].alias(c) if c in new else F.col(c) for c in irfs.columns])
