"""Queries on cross-fitting, tuning, long-run variance and stage two."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from foldwise.functions.dist import fixed_b_bartlett, normal_critical
from foldwise.operators.crossfit import crossfit_ml, learner_table
from foldwise.operators.design import build_design, feature_names, simple_design
from foldwise.operators.evaluate import evaluate, sweep
from foldwise.operators.hac import default_bandwidth, first_autocorrelation, lrv, rule_bandwidth
from foldwise.operators.position import add_position, ordered_select
from foldwise.operators.stage2 import block_statistics, fold_fits, full_statistics, stage2
from foldwise.operators.storage import attach, materialize
from foldwise.operators.tuning import (
    custom_profile, error_profile, least_error_select, selected_params, stability_select)
from foldwise.plans.analyses import Sample, static_effect, tuned_effect
from foldwise.plans.spec import Design, Inference, Learner
from foldwise.sources.frames import effect_frame
from workload import series, sql
from workload.registry import query, rnd

# ---------------------------------------------------------------- samples


def event_sample(spark, sf_dir, k=6, design="rcf", leads=1, keys=(), step=0.0):
    """Outcome ``value``, policy ``k``, control: the value of the event before, by ``step`` higher in the second half."""
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "user_id", "value", "k"), "event_id", keys)
    rows = ordered_select(
        placed, lambda w: [*keys, "event_id", "pos", "n_rows", "value", "k", F.lag("value", 1).over(w).alias("x"),
                           *[F.lead("value", h).over(w).alias(f"v{h}") for h in range(1, leads)]],
        keys, before=1, after=leads - 1)
    cut = F.col("n_rows") - leads
    rows = rows.where((F.col("pos") >= 1) & (F.col("pos") <= cut)).withColumns({"pos": F.col("pos") - 1, "n_rows": cut})
    if step:
        rows = rows.withColumn("x", F.col("x") + F.when(2 * F.col("pos") >= F.col("n_rows"), step).otherwise(0.0))
    rows = simple_design(rows, "value", "k", ["x"], k, keys, "event_id", ["value", *[f"v{h}" for h in range(1, leads)]])
    return Sample(materialize(rows), ("x",), k, tuple(keys), "event_id", design)


def event_rows(k, leads=1, keys=""):
    part = f"PARTITION BY {keys} " if keys else ""
    ahead = "".join(f", lead(value, {h}) OVER ({part}ORDER BY event_id) AS v{h}" for h in range(1, leads))
    full = " AND ".join(["x IS NOT NULL", *[f"v{h} IS NOT NULL" for h in range(1, leads)]])
    inner = f"SELECT * FROM (SELECT *, lag(value) OVER ({part}ORDER BY event_id) AS x{ahead} FROM ({sql.EVENTS})) WHERE {full}"
    return sql.blocked(sql.numbered(inner, "event_id", keys), k)


WEEKLY = Design("ts", "revenue", "avg_disc", {"revenue": 5, "avg_disc": 2}, lags=1)

_WEEKLY_SQL = f"""SELECT *, d AS k, y AS value FROM (SELECT ts, y, d, lag(y) OVER (ORDER BY ts) AS x, lag(d) OVER (ORDER BY ts) AS x2
  FROM (SELECT ts, 100 * (ln(revenue) - lag(ln(revenue)) OVER (ORDER BY ts)) AS y, avg_disc - lag(avg_disc) OVER (ORDER BY ts) AS d
  FROM ({sql.sales()}))) WHERE x2 IS NOT NULL"""


def weekly_rows(k):
    whole = sql.numbered(_WEEKLY_SQL, "ts")
    cut = f"SELECT * EXCLUDE (n_rows), n_rows - n_rows % {k} AS n_rows FROM ({whole}) WHERE pos < n_rows - n_rows % {k}"
    return sql.blocked(cut, k)


def weekly_sample(spark, sf_dir, k=6, design="rcf"):
    spec = replace(WEEKLY, n_blocks=k)
    rows = build_design(series.sales(spark, sf_dir), spec)
    return Sample(rows, tuple(feature_names(replace(spec, constant=False))), k, design=design)


# ---------------------------------------------------------------- residuals

_TARGETS = {"chi0": "value", "xi": "k"}


def _residual_query(name, kind, penalty, k=6, design="rcf", share=0.5):
    text = sql.residuals(event_rows(k), k, _TARGETS, kind, str(penalty), design)

    @query(f"{name}_residuals_events", f"WITH {text} SELECT pos, block_id, round(chi0, 6) AS chi0, round(xi, 6) AS xi FROM resid")
    def run(spark, sf_dir):
        learner = Learner(kind, penalty, share if kind == "elastic" else 1.0)
        resid = event_sample(spark, sf_dir, k, design).residuals(outcome=learner, policy=learner)
        return resid.select("pos", "block_id", rnd("chi0"), rnd("xi"))


_residual_query("ols", "ols", 0.0)
_residual_query("lasso", "lasso", 5.0)
_residual_query("ridge", "ridge", 4000.0)
_residual_query("elastic", "elastic", 3.0)
_residual_query("central_fold", "ols", 0.0, k=5)
_residual_query("buffered", "lasso", 2.0, k=6, design="nlo")


# Two controls by Cramer's rule on centred sums.
def _two_controls(k):
    lines = []
    for eq in ("y", "d"):
        lines.append(f"""SELECT fold, side, '{eq}' AS eq, avg({eq}) AS m, avg(x) AS m1, avg(x2) AS m2, var_pop(x) AS s11, var_pop(x2) AS s22,
          covar_pop(x, x2) AS s12, covar_pop(x, {eq}) AS c1, covar_pop(x2, {eq}) AS c2 FROM src JOIN tr ON tr.block = src.block_id
          GROUP BY ALL""")
    return f"""src AS ({weekly_rows(k)}), folds AS (SELECT unnest(range({k})) AS fold), blocks AS (SELECT unnest(range({k})) AS block),
      tr AS ({sql.trains('rcf', k)}), agg AS ({' UNION ALL '.join(lines)}),
      w AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM agg),
      lines AS (SELECT fold, eq, avg(b1) AS b1, avg(b2) AS b2, avg(m - b1 * m1 - b2 * m2) AS a FROM w GROUP BY ALL),
      resid AS (SELECT s.pos, s.n_rows, s.block_id, max(CASE WHEN eq = 'y' THEN s.y - a - b1 * s.x - b2 * s.x2 END) AS chi,
        max(CASE WHEN eq = 'd' THEN s.d - a - b1 * s.x - b2 * s.x2 END) AS xi
        FROM src s JOIN lines l ON l.fold = s.block_id GROUP BY ALL)"""


def _weekly_residuals(k):
    @query(f"ols_residuals_weekly_k{k}", f"WITH {_two_controls(k)} SELECT pos, block_id, round(chi, 5) AS chi0, round(xi, 7) AS xi FROM resid")
    def run(spark, sf_dir):
        return weekly_sample(spark, sf_dir, k).residuals().select("pos", "block_id", rnd("chi0", 5), rnd("xi", 7))


for _k in (6, 7):
    _weekly_residuals(_k)


_STEP = f"SELECT * REPLACE (x + CASE WHEN 2 * pos >= n_rows THEN 1e7::DOUBLE ELSE 0 END AS x) FROM ({event_rows(6)})"


@query("ols_residuals_level_shift", f"WITH {sql.residuals(_STEP, 6, _TARGETS)} SELECT pos, block_id, round(chi0, 4) AS chi0, round(xi, 4) AS xi FROM resid")
def level_shift(spark, sf_dir):
    """A control whose level moves by ten million halfway: digits must not be lost."""
    return event_sample(spark, sf_dir, step=1e7).residuals().select("pos", "block_id", rnd("chi0", 4), rnd("xi", 4))


@query("per_fold_learners_events", "WITH " + sql.residuals(
    event_rows(6), 6, _TARGETS, "lasso", "(CASE WHEN eq = 'xi' THEN 0.5 * fold ELSE 6.0 - fold END)")
    + " SELECT pos, block_id, round(chi0, 6) AS chi0, round(xi, 6) AS xi FROM resid")
def per_fold_learners(spark, sf_dir):
    learners = learner_table(spark, 6, [Learner("lasso", 6.0 - f) for f in range(6)], [Learner("lasso", 0.5 * f) for f in range(6)])
    return event_sample(spark, sf_dir).residuals(learners).select("pos", "block_id", rnd("chi0"), rnd("xi"))


@query("user_panel_residuals", "WITH " + sql.residuals(event_rows(4, keys="user_id"), 4, _TARGETS, keys="user_id")
       + " SELECT user_id, pos, block_id, round(chi0, 5) AS chi0, round(xi, 5) AS xi FROM resid")
def user_panel_residuals(spark, sf_dir):
    sample = event_sample(spark, sf_dir, 4, keys=("user_id",))
    resid = sample.residuals()
    return resid.select("user_id", "pos", "block_id", rnd("chi0", 5), rnd("xi", 5))


# A constant and 119 groups: least squares on indicators are means by group.
_GROUPS = 120
_GROUP_ROWS = sql.blocked(sql.numbered(sql.EVENTS, "event_id"), 4)


@query("many_controls_events", f"""WITH src AS (SELECT *, event_id % {_GROUPS} AS g FROM ({_GROUP_ROWS}) WHERE block_id IS NOT NULL),
  folds AS (SELECT unnest(range(4)) AS fold), blocks AS (SELECT unnest(range(4)) AS block), tr AS ({sql.trains('rcf', 4)}),
  means AS (SELECT fold, g, avg(value) AS my, avg(k) AS md FROM src JOIN tr ON tr.block = src.block_id GROUP BY ALL)
  SELECT s.pos, s.block_id, round(s.value - m.my, 5) AS chi0, round(s.k - m.md, 5) AS xi FROM src s JOIN means m ON m.fold = s.block_id AND m.g = s.g""")
def many_controls(spark, sf_dir):
    """119 controls: sums of 7,381 products per block, and residuals by matrix products."""
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value", "k"), "event_id")
    names = [f"g{j}" for j in range(1, _GROUPS)]
    group = [F.when(F.col("event_id") % _GROUPS == j, 1.0).otherwise(0.0).alias(f"g{j}") for j in range(1, _GROUPS)]
    rows = simple_design(placed.select("*", *group), "value", "k", names, 4, (), "event_id", ["value"])
    return Sample(materialize(rows), tuple(names), 4, (), "event_id").residuals().select("pos", "block_id", rnd("chi0", 5), rnd("xi", 5))


@query("rows_outside_folds", f"SELECT user_id, count(*) AS n_outside FROM ({event_rows(4, keys='user_id')}) WHERE block_id IS NULL GROUP BY 1")
def rows_outside(spark, sf_dir):
    rows = event_sample(spark, sf_dir, 4, keys=("user_id",)).rows.where("n_rows >= 4 and block_id is null")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_outside"))


@query("lead_residuals_events", "WITH " + sql.residuals(
    event_rows(6, 4), 6, {"chi0": "value", "chi1": "v1", "chi2": "v2", "chi3": "v3", "xi": "k"})
    + " SELECT pos, block_id, round(xi, 6) AS xi, " + ", ".join(f"round(chi{h}, 6) AS chi{h}" for h in range(4)) + " FROM resid")
def lead_residuals(spark, sf_dir):
    resid = event_sample(spark, sf_dir, leads=4).residuals()
    return resid.select("pos", "block_id", rnd("xi"), *[rnd(f"chi{h}") for h in range(4)])


@query("crossfit_tree_weekly")
def library_tree(spark, sf_dir):
    """Learners from the Spark library: one tree per fold, equation and side."""
    from pyspark.ml.regression import DecisionTreeRegressor

    sample = weekly_sample(spark, sf_dir, 4)
    tree = DecisionTreeRegressor(maxDepth=3, seed=1)
    return crossfit_ml(sample.rows, sample.features, tree, tree, 4).select("pos", "block_id", rnd("chi0"), rnd("xi"))


@query("crossfit_library_ols_weekly", f"WITH {_two_controls(6)} SELECT pos, block_id, round(chi, 4) AS chi0, round(xi, 6) AS xi FROM resid")
def library_ols(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression

    sample = weekly_sample(spark, sf_dir)
    line = LinearRegression(solver="normal", regParam=0.0)
    return crossfit_ml(sample.rows, sample.features, line, line, 6).select("pos", "block_id", rnd("chi0", 4), rnd("xi", 6))


# ---------------------------------------------------------------- tuning

_GRID = [0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4]
_GRID_SQL = f"(SELECT unnest(range({len(_GRID)}))::INT AS grid_idx, unnest({_GRID})::DOUBLE AS penalty)"


def _profile_sql(metric: str = "sqrt(avg(e * e))") -> str:
    """Validation error of a one-control lasso for every fold, equation and penalty."""
    near = "CASE WHEN fold < 3 THEN fold + 1 ELSE fold - 1 END"
    parts = []
    for eq, col in (("outcome", "value"), ("policy", "k")):
        parts.append(f"""SELECT fold, '{eq}' AS equation, count(*) AS n_train, avg({col}) AS my, avg(x) AS mx, covar_pop({col}, x) AS c,
          var_pop(x) AS v FROM src JOIN tr ON tr.block = src.block_id WHERE tr.block <> {near} GROUP BY ALL""")
    return f"""src AS ({event_rows(6)}), folds AS (SELECT unnest(range(6)) AS fold), blocks AS (SELECT unnest(range(6)) AS block),
      tr AS ({sql.trains('rcf', 6)}), agg AS ({' UNION ALL '.join(parts)}),
      lines AS (SELECT *, {sql.soft('c', 'penalty')} / v AS b FROM agg, {_GRID_SQL} grid),
      profile AS (SELECT fold::INT AS fold, equation, grid_idx, penalty, n_train, count(*) AS n_val, {metric} AS rmse FROM (SELECT l.*,
        CASE WHEN equation = 'outcome' THEN s.value ELSE s.k END - l.my - l.b * (s.x - l.mx) AS e
        FROM lines l JOIN src s ON s.block_id = {near}) GROUP BY fold, equation, grid_idx, penalty, n_train)"""


_LASSO_GRID = [("lasso", {"penalty": _GRID})]


@query("error_profile_events", f"WITH {_profile_sql()} SELECT fold, equation, grid_idx, penalty, n_train, n_val, round(rmse, 8) AS rmse FROM profile")
def profile_events(spark, sf_dir):
    sample = event_sample(spark, sf_dir)
    profile = error_profile(sample.gram(), _LASSO_GRID, _LASSO_GRID, 1, 0, 6)
    return profile.select("fold", "equation", "grid_idx", "penalty", "n_train", "n_val", rnd("rmse", 8))


@query("custom_metric_profile_events", f"WITH {_profile_sql('avg(abs(e))')} SELECT fold, equation, grid_idx, round(rmse, 7) AS rmse FROM profile")
def custom_metric(spark, sf_dir):
    """Mean absolute error as the validation metric."""
    sample = event_sample(spark, sf_dir)
    profile = custom_profile(sample.rows, sample.gram(), _LASSO_GRID, _LASSO_GRID, sample.features,
                             lambda y, f: F.avg(F.abs(y - f)), 6)
    return profile.select("fold", "equation", "grid_idx", rnd("rmse", 7))


# Curves measured on the tables: spread of the prices of a supplier by month of shipping.
_CURVES_SQL = """curves AS (SELECT l_suppkey, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate))::INT AS grid_idx,
  round(stddev_pop(l_extendedprice) / 1000, 3) AS rmse FROM lineitem GROUP BY 1, 2),
  ok AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY grid_idx) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n
    FROM curves)"""


def _curves(spark, sf_dir):
    lines = series.table(spark, sf_dir, "lineitem")
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("int")
    return lines.groupBy("l_suppkey", month.alias("grid_idx")).agg(
        F.round(F.stddev_pop("l_extendedprice") / 1000, 3).alias("rmse"))


def _stability_sql(window: int) -> str:
    full = "PARTITION BY l_suppkey"
    norm = lambda v: (f"CASE WHEN max({v}) OVER ({full}) - min({v}) OVER ({full}) > 1e-10 THEN ({v} - min({v}) OVER ({full})) / "  # noqa: E731
                      f"(max({v}) OVER ({full}) - min({v}) OVER ({full})) ELSE 0 END")
    return f"""{_CURVES_SQL}, win AS (SELECT *, CASE WHEN i <= n - {window} THEN avg(rmse) OVER f END AS m,
        CASE WHEN i <= n - {window} THEN var_pop(rmse) OVER f END AS v FROM ok
        WINDOW f AS ({full} ORDER BY grid_idx ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
      sc AS (SELECT *, CASE WHEN m IS NOT NULL THEN round({norm('v')} + {norm('m')}, 12) END AS score FROM win),
      st AS (SELECT *, CASE WHEN n > 1 THEN first_value(CASE WHEN score IS NOT NULL THEN i END) OVER ({full} ORDER BY score NULLS LAST, i) END AS start
        FROM sc),
      pick AS (SELECT *, row_number() OVER ({full} ORDER BY rmse, i) AS r FROM st WHERE start IS NULL OR i BETWEEN start AND start + {window - 1})
      SELECT l_suppkey, grid_idx, rmse FROM pick WHERE r = 1"""


def _stability_query(window):
    @query(f"stability_select_s{window}", f"WITH {_stability_sql(window)}")
    def run(spark, sf_dir):
        return stability_select(_curves(spark, sf_dir), window, ["l_suppkey"]).select("l_suppkey", "grid_idx", "rmse")


for _s in (3, 5):
    _stability_query(_s)


@query("least_error_select", f"""WITH {_CURVES_SQL} SELECT l_suppkey, grid_idx, rmse, i = n - 1 AS at_edge FROM ok
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY rmse, i) = 1""")
def least_error(spark, sf_dir):
    return least_error_select(_curves(spark, sf_dir), ["l_suppkey"]).select("l_suppkey", "grid_idx", "rmse", "at_edge")


@query("selected_params_events", f"""WITH {_profile_sql()}, best AS (SELECT * FROM profile
  QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY rmse, grid_idx) = 1)
  SELECT fold, max(n_train) AS n_train, max(n_val) AS n_val,
    {', '.join(f"max(CASE WHEN equation = '{e}' THEN penalty END) AS {e}_penalty, round(max(CASE WHEN equation = '{e}' THEN rmse END), 7) AS {e}_rmse, max(CASE WHEN equation = '{e}' THEN grid_idx = {len(_GRID) - 1} END) AS {e}_at_edge" for e in ('outcome', 'policy'))}
  FROM best GROUP BY fold""")
def selected_params_events(spark, sf_dir):
    tuned, _ = event_sample(spark, sf_dir).tune(_LASSO_GRID, _LASSO_GRID, "rmse")
    out = selected_params(tuned)
    return out.select("fold", "n_train", "n_val", *[
        c for e in ("outcome", "policy") for c in (f"{e}_penalty", rnd(f"{e}_rmse", 7), f"{e}_at_edge")])


@query("tuned_residuals_events", f"""WITH {_profile_sql()}, best AS (SELECT * FROM profile
    QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY rmse, grid_idx) = 1),
  full_agg AS (SELECT fold, equation, avg(t) AS my, avg(x) AS mx, covar_pop(t, x) AS c, var_pop(x) AS v FROM
    (SELECT fold, 'outcome' AS equation, value AS t, x FROM src JOIN tr ON tr.block = src.block_id UNION ALL
     SELECT fold, 'policy', k, x FROM src JOIN tr ON tr.block = src.block_id) GROUP BY ALL),
  final AS (SELECT f.fold, f.equation, f.my, f.mx, {sql.soft('f.c', 'b.penalty')} / f.v AS b FROM full_agg f JOIN best b
    ON b.fold = f.fold AND b.equation = f.equation)
  SELECT s.pos, s.block_id, round(max(CASE WHEN equation = 'outcome' THEN s.value - my - b * (s.x - mx) END), 6) AS chi0,
    round(max(CASE WHEN equation = 'policy' THEN s.k - my - b * (s.x - mx) END), 6) AS xi
  FROM src s JOIN final f ON f.fold = s.block_id GROUP BY ALL""")
def tuned_residuals(spark, sf_dir):
    """Penalties tuned per fold, then refitted on the whole training side."""
    sample = event_sample(spark, sf_dir)
    gram = sample.gram()
    tuned, _ = sample.tune(_LASSO_GRID, _LASSO_GRID, "rmse", gram=gram)
    return sample.residuals(tuned, gram=gram).select("pos", "block_id", rnd("chi0"), rnd("xi"))


_TUNED = f"""WITH {_profile_sql()}, ok AS (SELECT *, row_number() OVER p - 1 AS i, count(*) OVER (PARTITION BY fold, equation) AS n FROM profile
    WINDOW p AS (PARTITION BY fold, equation ORDER BY grid_idx)),
  win AS (SELECT *, CASE WHEN i <= n - 3 THEN avg(rmse) OVER f END AS m, CASE WHEN i <= n - 3 THEN var_pop(rmse) OVER f END AS v FROM ok
    WINDOW f AS (PARTITION BY fold, equation ORDER BY grid_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
  lim AS (SELECT fold, equation, min(m) AS m0, max(m) AS m1, min(v) AS v0, max(v) AS v1 FROM win GROUP BY 1, 2),
  sc AS (SELECT w.*, CASE WHEN m1 - m0 > 1e-10 THEN (m - m0) / (m1 - m0) ELSE 0 END + CASE WHEN v1 - v0 > 1e-10 THEN (v - v0) / (v1 - v0) ELSE 0 END AS score
    FROM win w JOIN lim USING (fold, equation) WHERE m IS NOT NULL),
  st AS (SELECT fold, equation, i AS start FROM sc QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY round(score, 12), i) = 1),
  best AS (SELECT o.* FROM ok o JOIN st USING (fold, equation) WHERE o.i BETWEEN start AND start + 2
    QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY rmse, o.i) = 1),
  full_agg AS (SELECT fold, equation, avg(t) AS my, avg(x) AS mx, covar_pop(t, x) AS c, var_pop(x) AS v FROM
    (SELECT fold, 'outcome' AS equation, value AS t, x FROM src JOIN tr ON tr.block = src.block_id UNION ALL
     SELECT fold, 'policy', k, x FROM src JOIN tr ON tr.block = src.block_id) GROUP BY ALL),
  final AS (SELECT f.fold, f.equation, f.my, f.mx, {sql.soft('f.c', 'b.penalty')} / f.v AS b FROM full_agg f JOIN best b
    ON b.fold = f.fold AND b.equation = f.equation),
  resid AS (SELECT s.pos, s.block_id, max(CASE WHEN equation = 'outcome' THEN s.value - my - b * (s.x - mx) END) AS chi,
    max(CASE WHEN equation = 'policy' THEN s.k - my - b * (s.x - mx) END) AS xi FROM src s JOIN final f ON f.fold = s.block_id GROUP BY ALL),
  {sql.stage2_block("SELECT pos, block_id, chi, xi FROM resid")}"""


@query("tuned_effect_steady_window", f"{_TUNED} SELECT round(coef, 7) AS coef, round(std_error, 7) AS std_error, n::BIGINT AS n_obs, width AS bandwidth FROM effect")
def tuned_effect_steady(spark, sf_dir):
    """The whole tuned estimate with the steady-window rule: curves, choice, refit, effect."""
    out = tuned_effect(event_sample(spark, sf_dir), _LASSO_GRID, _LASSO_GRID)
    return out.select(rnd("coef", 7), rnd("std_error", 7), "n_obs", "bandwidth")


def wide_weekly(spark, sf_dir, horizons=0, lags=6):
    codes = {"revenue": 5, "avg_disc": 2, "n_lines": 5, "avg_tax": 1, "qty": 5, "n_returned": 2}
    spec = Design("ts", "revenue", "avg_disc", codes, fast=("n_lines", "avg_tax"), lags=lags, horizons=horizons)
    return Sample(build_design(series.sales(spark, sf_dir), spec), tuple(feature_names(spec)), 6)


def penalties(low, high, n):
    return [low + (high - low) * i / (n - 1) for i in range(n)]


@query("tuned_effect_weekly_wide")
def tuned_effect_wide(spark, sf_dir):
    """39 controls, 100 penalties, both equations, six folds: the steady-window rule."""
    y_grid = [("lasso", {"penalty": penalties(1e-4, 1.0, 100)})]
    d_grid = [("lasso", {"penalty": penalties(1e-6, 1e-3, 100)})]
    return tuned_effect(wide_weekly(spark, sf_dir), y_grid, d_grid).select(
        rnd("coef"), rnd("std_error"), rnd("ci_lower"), rnd("ci_upper"), "n_obs", "n_blocks")


# ---------------------------------------------------------------- long-run variance


def _lrv_query(kernel):
    @query(f"lrv_{kernel}_events", f"""WITH {sql.lrv(f"SELECT event_id AS pos, value AS s FROM ({sql.EVENTS})", kernel, sql.DEFAULT_WIDTH[kernel])}
      SELECT n AS n_obs, width AS bandwidth, round(v, 5) AS lrv_0_0 FROM lrv""")
    def run(spark, sf_dir):
        placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value"), "event_id")
        return lrv(placed, ["value"], kernel=kernel).select("n_obs", "bandwidth", rnd("lrv_0_0", 5))

    @query(f"lrv_{kernel}_users", f"""WITH {sql.lrv(f"SELECT user_id, event_id AS pos, value AS s FROM ({sql.EVENTS})", kernel, sql.DEFAULT_WIDTH[kernel], "1", "user_id")}
      SELECT user_id, n AS n_obs, width AS bandwidth, round(v, 5) AS lrv_0_0 FROM lrv WHERE n > 1""")
    def panel(spark, sf_dir):
        placed = add_position(series.events_long(spark, sf_dir).select("user_id", "event_id", "value"), "event_id", ["user_id"])
        return lrv(placed.where("n_rows > 1"), ["value"], ["user_id"], kernel, dof=1).select(
            "user_id", "n_obs", "bandwidth", rnd("lrv_0_0", 5))


for _kernel in ("bartlett", "qs", "parzen", "ewc"):
    _lrv_query(_kernel)


@query("lrv_ewc_many_terms", f"""WITH {sql.lrv(f"SELECT event_id AS pos, value AS s FROM ({sql.EVENTS})", "ewc", "n // 4")}
  SELECT n AS n_obs, width AS bandwidth, round(v, 5) AS lrv_0_0 FROM lrv""")
def lrv_many_terms(spark, sf_dir):
    """A quarter as many cosines as rows."""
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value"), "event_id")
    return lrv(placed, ["value"], kernel="ewc", bandwidth=F.floor(F.col("n_obs") / 4).cast("int")).select("n_obs", "bandwidth", rnd("lrv_0_0", 5))


@query("lrv_matrix_events", f"""WITH c AS (SELECT event_id AS pos, value - avg(value) OVER () AS s0, k - avg(k) OVER () AS s1 FROM ({sql.EVENTS})),
  r AS (SELECT *, row_number() OVER (ORDER BY pos) AS rn, count(*) OVER () AS n FROM c),
  l AS (SELECT *, unnest(range(0, 6)) AS lag FROM r),
  p AS (SELECT l.lag, l.n, sum(l.s0 * b.s0) AS p00, sum(l.s0 * b.s1 + l.s1 * b.s0) / 2 AS p01, sum(l.s1 * b.s1) AS p11
    FROM l JOIN r b ON b.rn = l.rn - l.lag GROUP BY ALL)
  SELECT max(n) AS n_obs, 5 AS bandwidth, {', '.join(f"round(sum(CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / 6.0::DOUBLE) END * p{a}) / max(n), 4) AS lrv_{a[0]}_{a[1]}" for a in ('00', '01', '11'))}
  FROM p""")
def lrv_matrix(spark, sf_dir):
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value", "k"), "event_id")
    out = lrv(placed, ["value", "k"], bandwidth=5)
    return out.select("n_obs", "bandwidth", rnd("lrv_0_0", 4), rnd("lrv_0_1", 4), rnd("lrv_1_1", 4))


@query("lrv_long_bandwidth", f"""WITH {sql.lrv(f"SELECT event_id AS pos, value AS s FROM ({sql.EVENTS})", "bartlett", "ceil(1.3 * sqrt(n))")}
  SELECT n AS n_obs, width AS bandwidth, round(v, 4) AS lrv_0_0 FROM lrv""")
def lrv_long(spark, sf_dir):
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value"), "event_id")
    return lrv(placed, ["value"], bandwidth=rule_bandwidth("lls_nw", F.col("n_obs"))).select(
        "n_obs", "bandwidth", rnd("lrv_0_0", 4))


def _long_query(kernel):
    @query(f"lrv_{kernel}_long", f"""WITH {sql.lrv(f"SELECT event_id AS pos, value AS s FROM ({sql.EVENTS})", kernel, "ceil(1.3 * sqrt(n))")}
      SELECT n AS n_obs, width AS bandwidth, round(v, 4) AS lrv_0_0 FROM lrv""")
    def run(spark, sf_dir):
        placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value"), "event_id")
        return lrv(placed, ["value"], kernel=kernel, bandwidth=rule_bandwidth("lls_nw", F.col("n_obs"))).select(
            "n_obs", "bandwidth", rnd("lrv_0_0", 4))


for _kernel in ("qs", "parzen"):
    _long_query(_kernel)


@query("bandwidth_rules_users", f"""WITH c AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS s FROM ({sql.EVENTS})),
  l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM c),
  a AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 AND avg(s * s) >= 1e-12 THEN least(greatest(sum(s * o) / sum(o * o), -0.97), 0.97) END AS r
    FROM l GROUP BY 1)
  SELECT user_id, n, 5 AS small_h4, 24 AS small_h40, greatest(floor(pow(n, 0.25)), 1)::INT AS pow14, greatest(floor(1.3221 * pow(n, 0.2)), 1)::INT AS pow15,
    greatest(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)), 1)::INT AS newey_west, greatest(ceil(1.3 * pow(n, 0.5)), 1)::INT AS lls_nw,
    greatest(floor(0.4 * pow(n, 2.0::DOUBLE / 3)), 1)::INT AS lls_ewc, 7 AS fixed7,
    CASE WHEN r IS NULL THEN greatest(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)), 1) ELSE
      greatest(floor(1.1447 * pow(4 * r * r / (pow(1 - r, 2) * pow(1 + r, 2)) * n, 1.0::DOUBLE / 3)), 1) END::INT AS andrews,
    floor(pow(n, 0.2))::INT AS parzen_default FROM a""")
def bandwidth_rules(spark, sf_dir):
    placed = add_position(series.events_long(spark, sf_dir).select("user_id", "event_id", "value"), "event_id", ["user_id"])
    means = materialize(placed.groupBy("user_id").agg(F.avg("value").alias("_m"), F.max("n_rows").alias("n_rows")))
    centred = attach(placed, means, ["user_id"]).select("user_id", "pos", (F.col("value") - F.col("_m")).alias("s"))
    rho = first_autocorrelation(centred, "s", ["user_id"])
    n = F.col("n")
    sizes = means.select("user_id", F.col("n_rows").alias("n")).join(rho, "user_id")
    return sizes.select(
        "user_id", "n", rule_bandwidth("small", horizon=4).alias("small_h4"), rule_bandwidth("small", horizon=40).alias("small_h40"),
        rule_bandwidth("pow14", n).alias("pow14"), rule_bandwidth("pow15", n).alias("pow15"),
        rule_bandwidth("newey-west", n).alias("newey_west"), rule_bandwidth("lls_nw", n).alias("lls_nw"),
        rule_bandwidth("lls_ewc", n).alias("lls_ewc"), rule_bandwidth("fixed", value=7).alias("fixed7"),
        rule_bandwidth("andrews", n, rho=F.col("rho")).alias("andrews"), default_bandwidth("parzen", n).alias("parzen_default"))


def _cubic(b, c):
    return f"round({c[0]} + {c[1]} * {b} + {c[2]} * {b} * {b} + {c[3]} * {b} * {b} * {b}, 6)"


@query("fixed_b_critical_users", f"""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT *, 4.0::DOUBLE / greatest(n, 4) AS b FROM u)
  SELECT user_id, {_cubic('b', (1.6449, 2.1859, 0.3142, -0.3427))} AS crit_90, {_cubic('b', (1.96, 2.9694, 0.416, -0.5324))} AS crit_95,
    {_cubic('b', (2.3263, 4.1618, 0.5368, -0.906))} AS crit_99, round({sql.Z95}, 9) AS normal_95 FROM b""")
def fixed_b(spark, sf_dir):
    sizes = series.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    b = F.lit(4.0) / F.greatest(F.col("n"), F.lit(4))
    return sizes.select("user_id", *[F.round(fixed_b_bartlett(level, b), 6).alias(f"crit_{round(100 * level)}") for level in (0.9, 0.95, 0.99)],
                        F.round(F.lit(normal_critical(0.95)), 9).alias("normal_95"))


# ---------------------------------------------------------------- stage two

_RAW = "SELECT event_id AS pos, block_id, value AS chi, k AS xi FROM (" + sql.blocked(sql.numbered(sql.EVENTS, "event_id"), 6) + ")"


def raw_residuals(spark, sf_dir, k=6, keys=()):
    """Value and policy of the events themselves as residuals."""
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "user_id", "value", "k"), "event_id", keys, k)
    return placed.select("event_id", *keys, "pos", "n_rows", "block_id", F.col("value").alias("chi"), F.col("k").alias("xi"))


@query("fold_slopes_events", f"""SELECT block_id, count(*) AS n_obs, round(regr_slope(chi, xi), 8) AS coef, round(regr_intercept(chi, xi), 6) AS const,
  round(sqrt((regr_syy(chi, xi) - regr_slope(chi, xi) * regr_sxy(chi, xi)) / (count(*) - 2) / regr_sxx(chi, xi)), 8) AS std_error
  FROM ({_RAW}) WHERE block_id IS NOT NULL GROUP BY 1""")
def fold_slopes(spark, sf_dir):
    return fold_fits(raw_residuals(spark, sf_dir)).select("block_id", "n_obs", rnd("coef", 8), rnd("const"), rnd("std_error", 8))


_EFFECT = ["coef", "std_error", "t_stat", "p_value", "ci_lower", "ci_upper"]


def _effect_out(df, *more):
    return df.select(*more, *[rnd(c, 7) for c in _EFFECT], "n_obs", "bandwidth")


def _effect_sql(ctes: str, crit: str = sql.Z95, df: str = "n - 2", by: str = "", where: str = "true", width: str = "width", se: str = "std_error"):
    key = f"{by}, " if by else ""
    t = f"abs(coef / {se})"
    return f"""WITH {ctes} SELECT {key}round(coef, 7) AS coef, round({se}, 7) AS std_error, round({t}, 7) AS t_stat,
      round({sql.t_p(t, df)}, 7) AS p_value, round(coef - {crit} * {se}, 7) AS ci_lower, round(coef + {crit} * {se}, 7) AS ci_upper,
      n::BIGINT AS n_obs, {width} AS bandwidth FROM effect WHERE {where}"""


def _stage2_query(name, spec, ctes, **more):
    @query(name, _effect_sql(ctes, **more))
    def run(spark, sf_dir):
        return _effect_out(stage2(raw_residuals(spark, sf_dir), spec))


_stage2_query("stage2_block_events", Inference(), sql.stage2_block(_RAW))
_stage2_query("stage2_no_intercept", Inference(intercept=False), sql.stage2_block(_RAW, intercept=False), df="n - 1")
_stage2_query("stage2_fold_average", Inference(se="fold_average"), sql.stage2_block(_RAW), width="NULL::INT", se="se_avg")
for _kernel in ("qs", "parzen", "ewc"):
    _stage2_query(f"stage2_block_{_kernel}", Inference(kernel=_kernel), sql.stage2_block(_RAW, _kernel))
_stage2_query("stage2_fixed_b", Inference(rule="newey-west", fixed_b=True),
              sql.stage2_block(_RAW, width="floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9))"),
              crit=f"(1.96 + 2.9694 * width / n + 0.416 * (width / n) ** 2 - 0.5324 * (width / n) ** 3)")
_stage2_query("stage2_long_bandwidth", Inference(rule="lls_nw"), sql.stage2_block(_RAW, width="ceil(1.3 * sqrt(n))"))
_stage2_query("stage2_fixed_bandwidth", Inference(rule="fixed", value=12), sql.stage2_block(_RAW, width="12"))


#: Whole designs over chunks far shorter than the table, beside the same SQL.
SHORT_CHUNKS = 1000


def _chunk_queries(kernel):
    @query(f"stage2_chunks_{kernel}", _effect_sql(sql.stage2_block(_RAW, kernel)))
    def run(spark, sf_dir):
        return _effect_out(stage2(raw_residuals(spark, sf_dir), Inference(kernel=kernel), chunk_rows=SHORT_CHUNKS))

    @query(f"lrv_chunks_{kernel}", f"""WITH {sql.lrv(f"SELECT event_id AS pos, value AS s FROM ({sql.EVENTS})", kernel, sql.DEFAULT_WIDTH[kernel])}
      SELECT n AS n_obs, width AS bandwidth, round(v, 5) AS lrv_0_0 FROM lrv""")
    def variance(spark, sf_dir):
        placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value"), "event_id")
        return lrv(placed, ["value"], kernel=kernel, chunk_rows=SHORT_CHUNKS).select("n_obs", "bandwidth", rnd("lrv_0_0", 5))


for _kernel in ("bartlett", "qs", "parzen", "ewc"):
    _chunk_queries(_kernel)


@query("lrv_chunks_long", f"""WITH {sql.lrv(f"SELECT event_id AS pos, value AS s FROM ({sql.EVENTS})", "bartlett", "ceil(1.3 * sqrt(n))")}
  SELECT n AS n_obs, width AS bandwidth, round(v, 4) AS lrv_0_0 FROM lrv""")
def lrv_chunks_long(spark, sf_dir):
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value"), "event_id")
    return lrv(placed, ["value"], bandwidth=rule_bandwidth("lls_nw", F.col("n_obs")), chunk_rows=SHORT_CHUNKS).select(
        "n_obs", "bandwidth", rnd("lrv_0_0", 4))


_FLAT = f"SELECT * REPLACE (CASE WHEN block_id = 2 THEN 3.0::DOUBLE ELSE xi END AS xi) FROM ({_RAW})"


def _flat_fold(name, spec, **more):
    """A fold whose policy residual is constant has no slope; the others are as if it were not there."""
    kernel = more.pop("kernel", "bartlett")

    @query(f"stage2_constant_fold_{name}", _effect_sql(sql.stage2_block(_FLAT, kernel, **more)))
    def run(spark, sf_dir):
        rows = raw_residuals(spark, sf_dir)
        rows = rows.withColumn("xi", F.when(F.col("block_id") == 2, 3.0).otherwise(F.col("xi")))
        return _effect_out(stage2(rows, spec, chunk_rows=SHORT_CHUNKS))


_flat_fold("bartlett", Inference(rule="fixed", value=5), width="5")
_flat_fold("long", Inference(rule="fixed", value=80), width="80")
_flat_fold("ewc", Inference(kernel="ewc"), kernel="ewc")

_HOLES = f"SELECT * FROM (SELECT event_id AS pos, block_id, value AS chi, k AS xi, click FROM ({sql.blocked(sql.numbered(sql.EVENTS, 'event_id'), 6)})) WHERE click = 0"


@query("stage2_missing_residuals", _effect_sql(sql.stage2_block(_HOLES)))
def missing_residuals(spark, sf_dir):
    """Rows without a residual (here: clicks) take no part and are not counted."""
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "value", "k", "click"), "event_id", n_blocks=6)
    missing = F.when(F.col("value") > 0, F.lit(float("nan")))  # NaN and NULL are both missing
    chi = F.when(F.col("click") == 1, missing).otherwise(F.col("value"))
    rows = placed.select("event_id", "pos", "n_rows", "block_id", chi.alias("chi"), F.col("k").alias("xi"))
    return _effect_out(stage2(rows, Inference(), chunk_rows=SHORT_CHUNKS))


_stage2_query("stage2_kernel_names", Inference(kernel="Newey-West", rule="NW1994"),
              sql.stage2_block(_RAW, width="floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9))"))

_BISECT = f"""{sql.stage2_block(_RAW, "ewc", "floor(0.4 * pow(n, 2.0 / 3.0))")}, bis AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, width AS df FROM effect
  UNION ALL SELECT i + 1, CASE WHEN p > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE (lo + hi) / 2 END, df
  FROM (SELECT *, {sql.t_p("((lo + hi) / 2)", "df")} AS p FROM bis WHERE i < 60))"""


@query("stage2_fixed_b_ewc", _effect_sql(_BISECT, crit="(SELECT max(lo) FROM bis)").replace("WITH ", "WITH RECURSIVE ", 1))
def fixed_b_ewc(spark, sf_dir):
    """Cosine errors with Student's t of as many degrees of freedom as terms."""
    return _effect_out(stage2(raw_residuals(spark, sf_dir), Inference(kernel="ewc", rule="lls_ewc", fixed_b=True)))


@query("effect_frame_events", f"""WITH {sql.stage2_block(_RAW)} SELECT round(coef, 7) AS coefficient, round(std_error, 7) AS std_error,
  round(abs(coef / std_error), 7) AS t_stat, n::BIGINT AS n_obs, k::BIGINT AS n_blocks FROM effect""")
def effect_frame_events(spark, sf_dir):
    row = effect_frame(stage2(raw_residuals(spark, sf_dir), Inference()))
    return row.select(rnd("coefficient", 7), rnd("std_error", 7), rnd("t_stat", 7), "n_obs", "n_blocks")


def _full_ctes(kernel, width):
    return f"""s2 AS (SELECT * FROM ({_RAW}) WHERE block_id IS NOT NULL), fit AS (SELECT count(*) AS nn, {sql.line_cols(True)} FROM s2),
      {sql.lrv("SELECT pos, (xi - center) * (chi - a - b * xi) AS s FROM s2, fit", kernel, width)},
      effect AS (SELECT b AS coef, sqrt(v * nn) / sxx AS std_error, nn AS n, width FROM fit, lrv)"""


_stage2_query("stage2_full_events", Inference(method="full", rule="newey-west"),
              _full_ctes("bartlett", "floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9))"))
_stage2_query("stage2_full_qs", Inference(method="full", rule="fixed", value=8, kernel="qs"), _full_ctes("qs", "8"))
_stage2_query("stage2_full_plain", Inference(method="full", hac=False),
              f"""effect AS (SELECT b AS coef, sqrt(sse / df / sxx) AS std_error, n, NULL::INT AS width FROM
                (SELECT count(*) AS n, {sql.line_cols(True)} FROM ({_RAW}) WHERE block_id IS NOT NULL))""")


_USERS_RAW = f"SELECT user_id, pos, n_rows, block_id, value AS chi, k AS xi FROM ({sql.blocked(sql.numbered(sql.EVENTS, 'event_id', 'user_id'), 4)})"


_USERS_CTES = f"{sql.stage2_block(_USERS_RAW, by='user_id')}, {sql.t_quantiles('effect')}"
_USERS_CRIT = f"(CASE WHEN n >= 100 THEN {sql.Z95} ELSE (SELECT crit FROM crit c WHERE c.n = effect.n) END)"


@query("stage2_users", _effect_sql(_USERS_CTES, by="user_id", crit=_USERS_CRIT).replace("WITH ", "WITH RECURSIVE ", 1))
def stage2_users(spark, sf_dir):
    """One effect per user; intervals of short series use the t quantile."""
    return _effect_out(stage2(raw_residuals(spark, sf_dir, 4, ["user_id"]), Inference(), ["user_id"]), "user_id")


@query("block_statistics_plain", f"""WITH f AS (SELECT block_id, count(*) AS n_obs, {sql.line_cols(True)} FROM ({_RAW}) WHERE block_id IS NOT NULL GROUP BY 1),
  g AS (SELECT *, sqrt(sse / df / sxx) AS se FROM f)
  SELECT block_id, n_obs, df, round(b, 7) AS coefficient, round(se, 7) AS std_error, round(abs(b / se), 7) AS t_statistic,
    round({sql.t_p('abs(b / se)', 'df')}, 7) AS p_value FROM g""")
def block_plain(spark, sf_dir):
    out = block_statistics(raw_residuals(spark, sf_dir), Inference(hac=False))
    return out.select("block_id", "n_obs", "df", *[rnd(c, 7) for c in ("coefficient", "std_error", "t_statistic", "p_value")])


def _robust_statistics(by, lag):
    key = "block_id, " if by else ""
    part = "block_id" if by else ""
    on = "s2.block_id = fit.block_id" if by else "true"
    onl = "fit.block_id = lrv.block_id" if by else "true"
    pull = "s2.block_id, " if by else ""
    outk = "fit.block_id, " if by else ""
    return f"""WITH s2 AS (SELECT * FROM ({_RAW}) WHERE block_id IS NOT NULL), fit AS (SELECT {key}count(*) AS nn, {sql.line_cols(True)} FROM s2 {'GROUP BY block_id' if by else ''}),
      {sql.lrv(f"SELECT {pull}pos, (xi - center) * (chi - a - b * xi) AS s FROM s2 JOIN fit ON {on}", "bartlett", str(lag), by=part)}
      SELECT {outk}nn AS n_obs, df, round(b, 7) AS coefficient, round(sqrt(v * nn) / sxx, 7) AS std_error,
        round(abs(b / (sqrt(v * nn) / sxx)), 6) AS t_statistic, round({sql.chi2_p("pow(b / (sqrt(v * nn) / sxx), 2)", "1")}, 6) AS p_value FROM fit JOIN lrv ON {onl}"""


@query("block_statistics_robust", _robust_statistics(True, 1))
def block_robust(spark, sf_dir):
    out = block_statistics(raw_residuals(spark, sf_dir), lag=1)
    return out.select("block_id", "n_obs", "df", rnd("coefficient", 7), rnd("std_error", 7), rnd("t_statistic", 6), rnd("p_value"))


@query("full_statistics_robust", _robust_statistics(False, 3))
def full_robust(spark, sf_dir):
    out = full_statistics(raw_residuals(spark, sf_dir), lag=3)
    return out.select("n_obs", "df", rnd("coefficient", 7), rnd("std_error", 7), rnd("t_statistic", 6), rnd("p_value"))


@query("static_effect_weekly", _effect_sql(f"{_two_controls(6)}, {sql.stage2_block('SELECT pos, block_id, chi, xi FROM resid')}").replace(", 7)", ", 4)"))
def static_effect_weekly(spark, sf_dir):
    """Effect of the change in the average discount on the growth of weekly revenue."""
    out = static_effect(weekly_sample(spark, sf_dir))
    return out.select(*[rnd(c, 4) for c in _EFFECT], "n_obs", "bandwidth")


@query("static_effect_buffered_events", _effect_sql(
    sql.residuals(event_rows(6), 6, _TARGETS, design="nlo") + ", "
    + sql.stage2_block("SELECT pos, block_id, chi0 AS chi, xi FROM resid")))
def static_effect_buffered(spark, sf_dir):
    return _effect_out(static_effect(event_sample(spark, sf_dir, 6, "nlo")))


# ---------------------------------------------------------------- many fits


@query("evaluate_users", f"""WITH RECURSIVE {_USERS_CTES},
  e AS (SELECT CASE WHEN n >= 64 THEN 'long' ELSE 'short' END AS design, coef, abs(coef - 0.5) <= {_USERS_CRIT} * std_error AS covered FROM effect)
  SELECT design, count(*) AS n_fits, round(100 * (avg(coef) - 0.5) / 0.5, 5) AS bias_pct, round(100 * abs(avg(coef) - 0.5) / 0.5, 5) AS abs_bias_pct,
    round(sqrt(avg((coef - 0.5) * (coef - 0.5))), 7) AS rmse, round(100 * avg(covered::INT), 5) AS coverage_pct FROM e GROUP BY 1""")
def evaluate_users(spark, sf_dir):
    fits = stage2(raw_residuals(spark, sf_dir, 4, ["user_id"]), Inference(), ["user_id"])
    fits = fits.withColumn("design", F.when(F.col("n_obs") >= 64, "long").otherwise("short"))
    return evaluate(fits, 0.5).select("design", "n_fits", rnd("bias_pct", 5), rnd("abs_bias_pct", 5), rnd("rmse", 7), rnd("coverage_pct", 5))


_SWEEP = {"bartlett": Inference(), "qs": Inference(kernel="qs"), "parzen": Inference(kernel="parzen"), "ewc": Inference(kernel="ewc")}


@query("sweep_kernels_events", " UNION ALL ".join(
    f"SELECT * FROM (WITH {sql.stage2_block(_RAW, k)} SELECT '{k}' AS spec, round(coef, 7) AS coef, round(std_error, 7) AS std_error FROM effect)"
    for k in _SWEEP))
def sweep_kernels(spark, sf_dir):
    return sweep(materialize(raw_residuals(spark, sf_dir)), _SWEEP).select("spec", rnd("coef", 7), rnd("std_error", 7))


@query("sweep_folds_events", " UNION ALL ".join(
    f"SELECT * FROM (WITH {sql.residuals(event_rows(k, 1), k, _TARGETS, design=d)}, {sql.stage2_block('SELECT pos, block_id, chi0 AS chi, xi FROM resid')} "
    f"SELECT '{d}' AS design, {k} AS n_blocks, round(coef, 7) AS coef, round(std_error, 7) AS std_error FROM effect)"
    for k, d in ((4, "rcf"), (5, "rcf"), (8, "nlo"))))
def sweep_folds(spark, sf_dir):
    out = None
    for k, design in ((4, "rcf"), (5, "rcf"), (8, "nlo")):
        part = static_effect(event_sample(spark, sf_dir, k, design)).select(
            F.lit(design).alias("design"), F.lit(k).alias("n_blocks"), rnd("coef", 7), rnd("std_error", 7))
        out = part if out is None else out.unionByName(part)
    return out
