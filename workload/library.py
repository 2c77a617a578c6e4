"""Queries on learners of the Spark library: grids, failures, every lead."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from foldwise.operators.library import crossfit_library, failed_candidates, library_profile, select_library, tuned_crossfit_library, vector_table
from workload import sql
from workload.estimating import event_rows, event_sample, weekly_rows, weekly_sample
from workload.registry import query, rnd

_REG = [0.0, 0.0001, 0.001, 0.01, 0.1, 1.0]
_NEAR = "CASE WHEN fold < 3 THEN fold + 1 ELSE fold - 1 END"


def _ridge_fits(train: str) -> str:
    """Aggregates by fold, side and equation of two controls; the library divides the penalty by the spread of the target."""
    parts = [f"""SELECT fold, side, '{eq}' AS equation, count(*) AS n_train, avg({c}) AS m, avg(x) AS m1, avg(x2) AS m2, var_pop(x) AS s11, var_pop(x2) AS s22,
      covar_pop(x, x2) AS s12, covar_pop(x, {c}) AS c1, covar_pop(x2, {c}) AS c2, stddev_pop({c}) AS sy FROM src JOIN ({train}) t ON t.block = src.block_id
      GROUP BY ALL""" for eq, c in (("outcome", "y"), ("policy", "d"))]
    return " UNION ALL ".join(parts)


_SOLVED = """SELECT *, (c1 * (s22 + l) - c2 * s12) / ((s11 + l) * (s22 + l) - s12 * s12) AS b1, (c2 * (s11 + l) - c1 * s12) / ((s11 + l) * (s22 + l) - s12 * s12) AS b2
  FROM (SELECT a.*, g.grid_idx, g.reg / a.sy AS l FROM {agg} a, grid g)"""

_RIDGE = f"""src AS ({weekly_rows(6)}), folds AS (SELECT unnest(range(6)) AS fold), blocks AS (SELECT unnest(range(6)) AS block),
  tr AS ({sql.trains('rcf', 6)}), grid AS (SELECT unnest(range({len(_REG)}))::INT AS grid_idx, unnest({_REG})::DOUBLE AS reg),
  tune AS ({_ridge_fits(f"SELECT * FROM tr WHERE block <> {_NEAR}")}), tuned AS ({_SOLVED.format(agg='tune')}),
  profile AS (SELECT t.fold::INT AS fold, equation, grid_idx, n_train, count(*) AS n_val,
    sqrt(avg(pow(CASE WHEN equation = 'outcome' THEN s.y ELSE s.d END - t.m - b1 * (s.x - m1) - b2 * (s.x2 - m2), 2))) AS rmse
    FROM tuned t JOIN src s ON s.block_id = {_NEAR.replace('fold', 't.fold')} GROUP BY t.fold, equation, grid_idx, n_train)"""


def _grid():
    from pyspark.ml.regression import LinearRegression

    return [(LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0), {"regParam": _REG})]


def _rows(sample):
    return vector_table(sample.rows, sample.features, sample.time_col)


@query("library_profile_weekly", f"WITH {_RIDGE} SELECT fold, equation, grid_idx, n_train, n_val, round(rmse, 7) AS rmse FROM profile")
def profile_weekly(spark, sf_dir):
    """Six ridge candidates of the library, both equations, six folds."""
    profile = library_profile(_rows(weekly_sample(spark, sf_dir)), _grid(), _grid(), 6)
    return profile.select("fold", "equation", "grid_idx", "n_train", "n_val", rnd("rmse", 7))


@query("tuned_library_weekly", f"""WITH {_RIDGE}, best AS (SELECT * FROM profile QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY rmse, grid_idx) = 1),
  whole AS ({_ridge_fits('SELECT * FROM tr')}), lines AS (SELECT w.* FROM ({_SOLVED.format(agg='whole')}) w JOIN best b
    ON b.fold = w.fold AND b.equation = w.equation AND b.grid_idx = w.grid_idx)
  SELECT s.pos, s.block_id, round(avg(CASE WHEN equation = 'outcome' THEN s.y - m - b1 * (s.x - m1) - b2 * (s.x2 - m2) END), 4) AS chi0,
    round(avg(CASE WHEN equation = 'policy' THEN s.d - m - b1 * (s.x - m1) - b2 * (s.x2 - m2) END), 6) AS xi
  FROM src s JOIN lines l ON l.fold = s.block_id GROUP BY s.pos, s.block_id""")
def tuned_weekly(spark, sf_dir):
    """A ridge grid tuned per fold through the library, then fitted on the whole training side."""
    out, _, _ = tuned_crossfit_library(_rows(weekly_sample(spark, sf_dir)), _grid(), _grid(), 6, "rmse")
    return out.select("pos", "block_id", rnd("chi0", 4), rnd("xi"))


def _with_failures():
    from pyspark.ml.regression import GeneralizedLinearRegression

    # Counts cannot be negative: this candidate fails on growth rates, in every fold.
    return [*_grid(), GeneralizedLinearRegression(family="poisson")]


@query("library_failures_weekly", f"""WITH {_RIDGE}, best AS (SELECT * FROM profile QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY rmse, grid_idx) = 1)
  SELECT fold, equation, grid_idx, grid_idx = {len(_REG) - 1} AS at_edge, 1::BIGINT AS n_failed FROM best""")
def failures(spark, sf_dir):
    """The choice closes over a candidate that fails: ranks and edges are those of the others."""
    profile = library_profile(_rows(weekly_sample(spark, sf_dir)), _with_failures(), _with_failures(), 6)
    failed = failed_candidates(profile).groupBy("fold", "equation").agg(F.count(F.lit(1)).alias("n_failed"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the failure is meant
        tuned = select_library(profile, "rmse")
    return tuned.join(failed, ["fold", "equation"]).select("fold", "equation", "grid_idx", "at_edge", "n_failed")


_LEADS = {"chi0": "value", "chi1": "v1", "chi2": "v2", "xi": "k"}


@query("library_leads_events", f"WITH {sql.residuals(event_rows(4, 3), 4, _LEADS)} "
       "SELECT pos, block_id, round(chi0, 5) AS chi0, round(chi1, 5) AS chi1, round(chi2, 5) AS chi2, round(xi, 5) AS xi FROM resid")
def library_leads(spark, sf_dir):
    """Learners of the library for three horizons; the policy is fitted once."""
    from pyspark.ml.regression import LinearRegression

    line = LinearRegression(solver="normal", regParam=0.0)
    out = crossfit_library(_rows(event_sample(spark, sf_dir, 4, leads=3)), {h: line for h in range(3)}, line, 4, time_col="event_id")
    return out.select("pos", "block_id", *[rnd(c, 5) for c in _LEADS])
