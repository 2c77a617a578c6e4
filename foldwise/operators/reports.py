"""Report tables: text rows made from result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.text import fixed, stars
from foldwise.operators.folds import sample_use_closed
from foldwise.operators.tuning import selected_params, stability_curve


def irf_report(irf: DataFrame, digits: int = 3, se_below: bool = True, show_ci: bool = True, ci_level: int = 95,
               keys=(), horizon_label: str = "h") -> DataFrame:
    """Estimate with stars, standard error below (``line`` 1) or beside, interval.

    ``horizon`` and ``line`` give the order of the rows.
    """
    for c in ("Horizon", "Coefficient"):
        if c not in irf.columns:
            raise KeyError(f"the impulse response needs a column {c!r}")
    se = F.col("Std_Error") if "Std_Error" in irf.columns else F.lit(None).cast("double")
    p = F.col("p_value") if "p_value" in irf.columns else F.lit(None).cast("double")
    low, high = f"CI_Lower_{ci_level}", f"CI_Upper_{ci_level}"
    with_ci = show_ci and low in irf.columns and high in irf.columns
    estimate = F.concat(fixed(F.col("Coefficient"), digits), stars(p))
    interval = F.concat(F.lit("["), fixed(F.col(low), digits), F.lit(", "), fixed(F.col(high), digits), F.lit("]")) if with_ci else F.lit("")
    label = F.col("Horizon").cast("string")
    if not se_below:
        extra = [interval.alias(f"{ci_level}% CI")] if with_ci else []
        return irf.select(*keys, F.col("Horizon").alias("horizon"), F.lit(0).alias("line"), label.alias(horizon_label),
                          estimate.alias("Estimate"), fixed(se, digits).alias("Std. error"), *extra)
    top = F.struct(F.lit(0).alias("line"), label.alias("l"), estimate.alias("e"), interval.alias("c"))
    below = F.when(se.isNotNull() & ~F.isnan(se), F.struct(
        F.lit(1).alias("line"), F.lit("").alias("l"),
        F.concat(F.lit("("), fixed(se, digits), F.lit(")")).alias("e"), F.lit("").alias("c")))
    lines = F.explode(F.filter(F.array(top, below), lambda x: x.isNotNull()))
    rows = irf.select(*keys, F.col("Horizon").alias("horizon"), lines.alias("_r"))
    return rows.select(*keys, "horizon", "_r.line", F.col("_r.l").alias(horizon_label), F.col("_r.e").alias("Estimate"),
                       *([F.col("_r.c").alias(f"{ci_level}% CI")] if with_ci else []))


# The row labels of a comparison, in order.
COMPARISON_ROWS = ("theta", "Std. error", "t-statistic", "p-value", "95% CI", "Folds K", "Sample use")


def compare_estimates(fits: DataFrame, labels, digits: int = 4, include_ci: bool = True,
                      include_blocks: bool = True) -> DataFrame:
    """Statistics as rows, fits as columns.

    ``fits`` has ``label, coef, std_error, t_stat, p_value, ci_lower, ci_upper``
    and, for the last two rows, ``n_blocks, design``; ``labels`` fixes the columns.
    """
    p, k = F.col("p_value"), F.col("n_blocks").cast("int")
    entries = [
        ("theta", F.concat(fixed(F.col("coef"), digits), stars(p))),
        ("Std. error", F.concat(F.lit("("), fixed(F.col("std_error"), digits), F.lit(")"))),
        ("t-statistic", fixed(F.col("t_stat"), 3)), ("p-value", fixed(p, 4))]
    if include_ci:
        entries.append(("95% CI", F.concat(F.lit("["), fixed(F.col("ci_lower"), digits), F.lit(", "),
                                           fixed(F.col("ci_upper"), digits), F.lit("]"))))
    if include_blocks:
        share = F.when(F.col("design") == "nlo", sample_use_closed(k, "nlo")).otherwise(sample_use_closed(k, "rcf"))
        entries += [("Folds K", k.cast("string")), ("Sample use", fixed(share, 3))]
    cells = F.explode(F.array(*[F.struct(F.lit(COMPARISON_ROWS.index(n)).alias("line"), F.lit(n).alias("statistic"),
                                         v.alias("value")) for n, v in entries]))
    tall = fits.select("label", cells.alias("_c")).select("label", "_c.line", "_c.statistic", "_c.value")
    return tall.groupBy("line", "statistic").pivot("label", list(labels)).agg(F.first("value"))


def tuning_report(tuned: DataFrame, digits: int = 6, keys=()) -> DataFrame:
    """Chosen penalty and validation error per fold, as text."""
    t = selected_params(tuned, keys)
    return t.select(*keys, F.col("fold").alias("Fold"), F.col("n_train").alias("n train"), F.col("n_val").alias("n validate"),
                    fixed(F.col("outcome_rmse"), digits).alias("Outcome RMSE"),
                    fixed(F.col("policy_rmse"), digits).alias("Policy RMSE"),
                    fixed(F.col("outcome_penalty"), 6).alias("Outcome penalty"),
                    fixed(F.col("policy_penalty"), 6).alias("Policy penalty"))


def overlay(irfs: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Several impulse responses in one table."""
    if not irfs:
        raise ValueError("no impulse responses were given")
    out = None
    for name, frame in irfs.items():
        part = frame.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def curve_report(profile: DataFrame, window: int = 3, by=("fold", "equation")) -> DataFrame:
    """The error curve with its chosen window, chosen candidate and lowest error."""
    return stability_curve(profile, window, by).select(
        *by, "grid_idx", *[c for c in ("penalty",) if c in profile.columns], "rmse", "in_window", "is_chosen", "is_lowest")
