"""Queries on impulse responses, residual checks and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldwise.operators.design import build_design, feature_names
from foldwise.operators.diagnostics import boundary_leakage, by_equation, diagnose, edge_rows, ljung_box
from foldwise.operators.projections import cumulate, local_projections, residual_table, scale_irfs
from foldwise.operators.reports import compare_estimates, curve_report, irf_report, overlay, tuning_report
from foldwise.operators.storage import materialize, shared_folder
from foldwise.plans.analyses import Sample, impulse_response, static_effect
from foldwise.plans.spec import Design, Inference, Learner
from foldwise.sources.frames import write_irf
from workload import series, sql
from workload.estimating import (
    _LASSO_GRID, _TARGETS, _profile_sql, event_rows, event_sample, penalties, raw_residuals, wide_weekly)
from workload.registry import query, rnd

_LEADS = 4
_LEAD_TARGETS = {"chi0": "value", "chi1": "v1", "chi2": "v2", "chi3": "v3", "xi": "k"}
IRF = ["Coefficient", "Std_Error", "t_stat", "p_value", "CI_Lower_95", "CI_Upper_95", "CI_Lower_90", "CI_Upper_90"]


def _irf_sql(chi=lambda h: f"chi{h}", k: int = 6, kind="ols", penalty="0", kernel="bartlett") -> str:
    """One row per horizon: ``Horizon`` and the columns of ``IRF``, unrounded."""
    parts = []
    for h in range(_LEADS):
        ctes = (sql.residuals(event_rows(k, _LEADS), k, _LEAD_TARGETS, kind, penalty) + ", "
                + sql.stage2_block(f"SELECT pos, block_id, {chi(h)} AS chi, xi FROM resid", kernel, str(h + 1)))
        parts.append(f"SELECT {h} AS \"Horizon\", coef, std_error, n FROM (WITH {ctes} SELECT * FROM effect)")
    t = "abs(coef / std_error)"
    return f"""SELECT "Horizon", coef AS "Coefficient", std_error AS "Std_Error", {t} AS t_stat, {sql.t_p(t, 'n - 2')} AS p_value,
      coef - {sql.Z95} * std_error AS "CI_Lower_95", coef + {sql.Z95} * std_error AS "CI_Upper_95",
      coef - 1.645::DOUBLE * std_error AS "CI_Lower_90", coef + 1.645::DOUBLE * std_error AS "CI_Upper_90" FROM ({' UNION ALL '.join(parts)})"""


def _rounded(inner: str, *more: str, digits: int = 7) -> str:
    head = "".join(f"{m}, " for m in more)
    return f"SELECT {head}\"Horizon\", {', '.join(f'round({c}, {digits}) AS {c}' for c in IRF)} FROM ({inner})"


def _irf_out(irf, *more, digits=7):
    return irf.select(*more, "Horizon", *[rnd(c, digits) for c in IRF])


def _irf(spark, sf_dir, code=None, **learner):
    return impulse_response(event_sample(spark, sf_dir, leads=_LEADS), code=code, **learner)


@query("irf_events", _rounded(_irf_sql()))
def irf_events(spark, sf_dir):
    return _irf_out(_irf(spark, sf_dir))


def _summed(h):
    return " + ".join(f"chi{j}" for j in range(h + 1))


@query("irf_cumulative_events", _rounded(_irf_sql(_summed)))
def irf_cumulative(spark, sf_dir):
    return _irf_out(_irf(spark, sf_dir, code=5))


@query("irf_learners_by_horizon", _rounded(_irf_sql(
    kind="lasso", penalty="(CASE eq WHEN 'chi0' THEN 1.0 WHEN 'chi1' THEN 2.0 WHEN 'chi2' THEN 3.0 WHEN 'chi3' THEN 4.0 ELSE 0.5 END)")))
def irf_by_horizon(spark, sf_dir):
    rows = [(f, "policy", -1, "lasso", 0.5, 1.0) for f in range(6)]
    rows += [(f, "outcome", h, "lasso", 1.0 + h, 1.0) for f in range(6) for h in range(_LEADS)]
    learners = spark.createDataFrame(rows, "fold int, equation string, h int, kind string, penalty double, l1_share double")
    return _irf_out(_irf(spark, sf_dir, learners=learners))


_CODES = (1, 5, 10, 101, 12, 6)


def _cumulated_sql(code: int, h: int) -> str:
    total = f"({_summed(h)})"
    return {5: total, 10: f"{total} / 12", 101: f"{total} / 4", 12: f"({total} + chi{h}) / 12"}.get(code, f"chi{h}")


@query("cumulate_codes_events", "WITH " + sql.residuals(event_rows(6, _LEADS), 6, _LEAD_TARGETS) + " SELECT pos, "
       + ", ".join(f"round({_cumulated_sql(c, h)}, 6) AS c{c}_h{h}" for c in _CODES for h in (0, 3)) + " FROM resid")
def cumulate_codes(spark, sf_dir):
    resid = event_sample(spark, sf_dir, leads=_LEADS).residuals()
    wide = resid.select("pos", *[F.array(*[F.col(f"chi{h}") for h in range(_LEADS)]).alias("_all")])
    for code in _CODES:
        part = wide.select("*", *[F.col("_all")[h].alias(f"chi{h}") for h in range(_LEADS)])
        part = cumulate(part, code)
        wide = part.withColumnsRenamed({"chi0": f"c{code}_h0", "chi3": f"c{code}_h3"}).drop("chi1", "chi2")
    return wide.select("pos", *[rnd(f"c{c}_h{h}") for c in _CODES for h in (0, 3)])


@query("residual_table_events", "WITH " + sql.residuals(event_rows(6, _LEADS), 6, _LEAD_TARGETS) + f"""
  SELECT e.event_id, round(xi, 6) AS treatment_resid, {', '.join(f'round(chi{h}, 6) AS outcome_resid_h{h}' for h in range(_LEADS))}
  FROM resid r JOIN src e ON e.pos = r.pos""")
def residual_table_events(spark, sf_dir):
    out = residual_table(event_sample(spark, sf_dir, leads=_LEADS).residuals(), time_col="event_id")
    return out.select("event_id", rnd("treatment_resid"), *[rnd(f"outcome_resid_h{h}") for h in range(_LEADS)])


def _outcomes(spark, sf_dir):
    """Responses of the value itself, and of the value cumulated, as two outcomes."""
    resid = event_sample(spark, sf_dir, leads=_LEADS).residuals()
    level = local_projections(resid, time_col="event_id").withColumn("outcome", F.lit("level"))
    total = local_projections(resid, Inference(kernel="qs"), 10, time_col="event_id").withColumn("outcome", F.lit("yearly"))
    return level.unionByName(total)


_YEARLY = _irf_sql(lambda h: f"({_summed(h)}) / 12", kernel="qs")
_SCALED = f"""WITH both_out AS (SELECT 'level' AS outcome, * FROM ({_irf_sql()}) UNION ALL SELECT 'yearly', * FROM ({_YEARLY})),
  f AS (SELECT 0.5 / (max(CASE WHEN outcome = 'level' THEN "Coefficient" END) - max(CASE WHEN outcome = 'yearly' THEN "Coefficient" END)) AS f
    FROM both_out WHERE "Horizon" = 0),
  m AS (SELECT b.*, f * CASE WHEN outcome = 'yearly' THEN 100 ELSE 1 END AS m FROM both_out b, f)
  SELECT outcome, "Horizon", round("Coefficient" * m, 5) AS "Coefficient", round("Std_Error" * abs(m), 5) AS "Std_Error",
    round(t_stat, 5) AS t_stat, round(p_value, 5) AS p_value,
    {', '.join(f'round(least("CI_Lower_{v}" * m, "CI_Upper_{v}" * m), 5) AS "CI_Lower_{v}", round(greatest("CI_Lower_{v}" * m, "CI_Upper_{v}" * m), 5) AS "CI_Upper_{v}"' for v in (95, 90))}
  FROM m"""


@query("scale_irfs_events", _SCALED)
def scale_irfs_events(spark, sf_dir):
    scaled = scale_irfs(materialize(_outcomes(spark, sf_dir)), "level", "yearly", ["yearly"], 0.5)
    return _irf_out(scaled, "outcome", digits=5)


@query("write_irf_events", _rounded(_irf_sql(), "'value' AS outcome", digits=6))
def write_irf_events(spark, sf_dir):
    path = f"{shared_folder(spark)}/irf-{uuid.uuid4().hex}"
    irf = _irf(spark, sf_dir).withColumn("outcome", F.lit("value"))
    write_irf(irf, path, ["outcome"])
    schema = ", ".join(["Horizon int", *[f"{c} double" for c in IRF], "outcome string"])
    return _irf_out(spark.read.csv(path, header=True, schema=schema), "outcome", digits=6)


_EST = "printf('%.3f', \"Coefficient\") || " + sql.STARS.format(p="p_value")
_CI = "'[' || printf('%.3f', \"CI_Lower_95\") || ', ' || printf('%.3f', \"CI_Upper_95\") || ']'"


@query("irf_report_events", f"""WITH i AS ({_irf_sql(_summed)})
  SELECT "Horizon" AS horizon, 0 AS line, "Horizon"::VARCHAR AS h, {_EST} AS "Estimate", {_CI} AS "95% CI" FROM i UNION ALL
  SELECT "Horizon", 1, '', '(' || printf('%.3f', "Std_Error") || ')', '' FROM i""")
def irf_report_events(spark, sf_dir):
    return irf_report(_irf(spark, sf_dir, code=5))


@query("irf_report_beside", f"""WITH i AS ({_irf_sql(_summed)})
  SELECT "Horizon" AS horizon, 0 AS line, "Horizon"::VARCHAR AS h, {_EST} AS "Estimate", printf('%.3f', "Std_Error") AS "Std. error",
    {_CI} AS "95% CI" FROM i""")
def irf_report_beside(spark, sf_dir):
    return irf_report(_irf(spark, sf_dir, code=5), se_below=False)


@query("overlay_irfs_events", f"{_rounded(_irf_sql(), chr(39) + 'plain' + chr(39) + ' AS label')} UNION ALL "
       + _rounded(_irf_sql(kind="lasso", penalty="5.0"), "'lasso' AS label"))
def overlay_irfs(spark, sf_dir):
    sample = event_sample(spark, sf_dir, leads=_LEADS)
    lasso = Learner("lasso", 5.0)
    return _irf_out(overlay({"plain": impulse_response(sample), "lasso": impulse_response(sample, outcome=lasso, policy=lasso)}), "label")


def _column_sql(label: str, design: str, k: int) -> str:
    ctes = sql.residuals(event_rows(k), k, _TARGETS, design=design) + ", " + sql.stage2_block(
        "SELECT pos, block_id, chi0 AS chi, xi FROM resid")
    share = {"rcf": (3 * k - 2) / (4 * k), "nlo": (k - 1) * (k - 2) / k ** 2}[design]
    t = "abs(coef / std_error)"
    return f"""SELECT unnest(range(7))::INT AS line, unnest(['theta', 'Std. error', 't-statistic', 'p-value', '95% CI', 'Folds K', 'Sample use']) AS statistic,
      unnest([printf('%.4f', coef) || {sql.STARS.format(p='p')}, '(' || printf('%.4f', std_error) || ')', printf('%.3f', {t}), printf('%.4f', p),
        '[' || printf('%.4f', coef - {sql.Z95} * std_error) || ', ' || printf('%.4f', coef + {sql.Z95} * std_error) || ']', '{k}', '{share:.3f}']) AS {label}
      FROM (SELECT *, {sql.t_p(t, 'n - 2')} AS p FROM (WITH {ctes} SELECT * FROM effect))"""


@query("compare_estimates_events", f"SELECT line, statistic, one_sided, buffered FROM ({_column_sql('one_sided', 'rcf', 6)}) JOIN "
       f"({_column_sql('buffered', 'nlo', 8)}) USING (line, statistic)")
def compare_events(spark, sf_dir):
    fits = None
    for label, design, k in (("one_sided", "rcf", 6), ("buffered", "nlo", 8)):
        fit = static_effect(event_sample(spark, sf_dir, k, design)).withColumn("label", F.lit(label)).withColumn("design", F.lit(design))
        fits = fit if fits is None else fits.unionByName(fit)
    return compare_estimates(fits, ["one_sided", "buffered"])


@query("tuning_report_events", f"""WITH {_profile_sql()}, best AS (SELECT * FROM profile
    QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY rmse, grid_idx) = 1)
  SELECT fold AS "Fold", max(n_train) AS "n train", max(n_val) AS "n validate",
    {', '.join(f"printf('%.6f', max(CASE WHEN equation = '{e}' THEN rmse END)) AS " + chr(34) + f"{e.capitalize()} RMSE" + chr(34) for e in ('outcome', 'policy'))},
    {', '.join(f"printf('%.6f', max(CASE WHEN equation = '{e}' THEN penalty END)) AS " + chr(34) + f"{e.capitalize()} penalty" + chr(34) for e in ('outcome', 'policy'))}
  FROM best GROUP BY fold""")
def tuning_report_events(spark, sf_dir):
    tuned, _ = event_sample(spark, sf_dir).tune(_LASSO_GRID, _LASSO_GRID, "predictive")
    return tuning_report(tuned)


@query("curve_report_events", f"""WITH {_profile_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY fold, equation ORDER BY rmse, grid_idx) AS r,
    grid_idx AS i, count(*) OVER (PARTITION BY fold, equation) AS n FROM profile),
  win AS (SELECT *, CASE WHEN i <= n - 3 THEN avg(rmse) OVER f END AS m, CASE WHEN i <= n - 3 THEN var_pop(rmse) OVER f END AS v FROM r
    WINDOW f AS (PARTITION BY fold, equation ORDER BY grid_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
  lim AS (SELECT fold, equation, min(m) AS m0, max(m) AS m1, min(v) AS v0, max(v) AS v1 FROM win GROUP BY 1, 2),
  sc AS (SELECT fold, equation, i, CASE WHEN m1 - m0 > 1e-10 THEN (m - m0) / (m1 - m0) ELSE 0 END + CASE WHEN v1 - v0 > 1e-10 THEN (v - v0) / (v1 - v0) ELSE 0 END AS score
    FROM win JOIN lim USING (fold, equation) WHERE m IS NOT NULL),
  st AS (SELECT fold, equation, i AS start FROM sc QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY round(score, 12), i) = 1),
  inside AS (SELECT r.*, i BETWEEN start AND start + 2 AS in_window FROM r JOIN st USING (fold, equation))
  SELECT fold, equation, grid_idx, penalty, round(rmse, 7) AS rmse, in_window, r = 1 AS is_lowest,
    in_window AND row_number() OVER (PARTITION BY fold, equation, in_window ORDER BY rmse, grid_idx) = 1 AS is_chosen FROM inside""")
def curve_report_events(spark, sf_dir):
    sample = event_sample(spark, sf_dir)
    _, profile = sample.tune(_LASSO_GRID, _LASSO_GRID)
    return curve_report(profile).select("fold", "equation", "grid_idx", "penalty", rnd("rmse", 7), "in_window", "is_chosen", "is_lowest")


# ---------------------------------------------------------------- checks on residuals


def _ljung_sql(source: str, key: str = "", lags: int = 8) -> str:
    lead, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    on = f" AND b.{key} = l.{key}" if key else ""
    pull = f"l.{key}, " if key else ""
    return f"""WITH c AS (SELECT *, r - avg(r) OVER ({part}) AS e, row_number() OVER ({part}ORDER BY pos) AS rn, count(*) OVER ({part}) AS n FROM ({source})),
      l AS (SELECT *, unnest(range(0, {lags + 1})) AS lag FROM c),
      p AS (SELECT {pull}l.lag, l.n, sum(l.e * b.e) AS p FROM l JOIN c b ON b.rn = l.rn - l.lag{on} GROUP BY ALL),
      q AS (SELECT *, max(CASE WHEN lag = 0 THEN p END) OVER ({part}) AS p0 FROM p),
      s AS (SELECT {lead}lag, n * (n + 2) * sum(p * p / (p0 * p0) / (n - lag)) OVER ({part}ORDER BY lag) AS x FROM q WHERE lag > 0)
      SELECT {lead}lag::INT AS lag, round(x, 5) AS lb_stat,
        round({sql.chi2_p('x', 'lag')}, 6) AS lb_pvalue FROM s"""


def _ljung_out(df, *more):
    return df.select(*more, "lag", rnd("lb_stat", 5), rnd("lb_pvalue"))


@query("ljung_box_events", _ljung_sql(f"SELECT event_id AS pos, value AS r FROM ({sql.EVENTS})"))
def ljung_events(spark, sf_dir):
    return _ljung_out(ljung_box(raw_residuals(spark, sf_dir), "chi"))


@query("ljung_box_equations", _ljung_sql(f"""SELECT unnest(['policy', 'outcome']) AS equation, unnest([xi, chi0]) AS r, pos FROM
  (WITH {sql.residuals(event_rows(6), 6, _TARGETS)} SELECT * FROM resid)""", "equation"))
def ljung_equations(spark, sf_dir):
    resid = event_sample(spark, sf_dir).residuals()
    return _ljung_out(ljung_box(by_equation(resid), "r", keys=["equation"]), "equation")


def _edges_sql(m: int, k: int) -> str:
    near = f"pos % (n_rows // {k})"
    shifts = ", ".join([f"lag(chi, {s}) OVER (ORDER BY pos) AS lag{s}" for s in range(m, 0, -1)]
                       + [f"lead(chi, {s}) OVER (ORDER BY pos) AS lead{s}" for s in range(1, m + 1)])
    rows = f"SELECT pos, n_rows, block_id, value AS chi FROM ({sql.blocked(sql.numbered(sql.EVENTS, 'event_id'), k)}) WHERE block_id IS NOT NULL"
    return f"""SELECT pos, block_id, chi AS r, {', '.join(f'lag{s}' for s in range(m, 0, -1))}, {', '.join(f'lead{s}' for s in range(1, m + 1))}
      FROM (SELECT *, {shifts} FROM ({rows})) WHERE ({near} < {m} OR {near} >= n_rows // {k} - {m}) AND pos >= {m} AND pos < n_rows - {m}"""


@query("leakage_edges_events", _edges_sql(2, 40))
def leakage_edges(spark, sf_dir):
    return edge_rows(raw_residuals(spark, sf_dir, 40), "chi", 40, 2).select("pos", "block_id", "r", "lag2", "lag1", "lead1", "lead2")


@query("boundary_leakage_events", f"""WITH e AS ({_edges_sql(1, 40)}),
  a AS (SELECT count(*) AS n, var_pop(r) AS yy, var_pop(lag1) AS s11, var_pop(lead1) AS s22, covar_pop(lag1, lead1) AS s12,
    covar_pop(r, lag1) AS c1, covar_pop(r, lead1) AS c2 FROM e),
  b AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM a),
  f AS (SELECT *, (b1 * c1 + b2 * c2) / 2 / ((yy - b1 * c1 - b2 * c2) / (n - 3)) AS f FROM b)
  SELECT 'pooled' AS fold, round(f, 6) AS "F_stat", round(pow((n - 3) / (n - 3 + 2 * f), (n - 3) / 2.0::DOUBLE), 6) AS p_value, n AS n_obs, 2 AS df FROM f
  UNION ALL SELECT block_id::VARCHAR, NULL, NULL, count(*), 0 FROM e GROUP BY block_id""")
def leakage_events(spark, sf_dir):
    return boundary_leakage(raw_residuals(spark, sf_dir, 40), "chi", 40, 1).select(
        "fold", rnd("F_stat"), rnd("p_value"), "n_obs", "df")


def _leak_sql(source: str, k: int) -> str:
    """The pooled test with one neighbour on each side, by equation, from ``equation, pos, n_rows, r``."""
    near, part = f"pos % (n_rows // {k})", "PARTITION BY equation"
    return f"""e AS (SELECT * FROM (SELECT *, lag(r) OVER ({part} ORDER BY pos) AS l1, lead(r) OVER ({part} ORDER BY pos) AS l2 FROM ({source}))
      WHERE ({near} < 1 OR {near} >= n_rows // {k} - 1) AND pos >= 1 AND pos < n_rows - 1 AND l1 IS NOT NULL AND l2 IS NOT NULL),
    a AS (SELECT equation, count(*) AS n, var_pop(r) AS yy, var_pop(l1) AS s11, var_pop(l2) AS s22, covar_pop(l1, l2) AS s12, covar_pop(r, l1) AS c1, covar_pop(r, l2) AS c2
      FROM e GROUP BY 1),
    b AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM a),
    leak AS (SELECT *, (b1 * c1 + b2 * c2) / 2 / ((yy - b1 * c1 - b2 * c2) / (n - 3)) AS f FROM b)"""


_BOTH = f"SELECT unnest(['policy', 'outcome']) AS equation, unnest([xi, chi0]) AS r, pos, n_rows FROM (WITH {sql.residuals(event_rows(40), 40, _TARGETS)} SELECT * FROM resid)"


@query("diagnose_events", f"""WITH {_leak_sql(_BOTH, 40)}
  SELECT 'leakage' AS test, equation, NULL::INT AS lag, round(f, 5) AS statistic, round(pow((n - 3) / (n - 3 + 2 * f), (n - 3) / 2.0::DOUBLE), 6) AS p_value FROM leak
  UNION ALL SELECT 'ljung_box', equation, lag, lb_stat, lb_pvalue FROM ({_ljung_sql(f'SELECT equation, r, pos FROM ({_BOTH})', 'equation')})""")
def diagnose_events(spark, sf_dir):
    """Both tests of both residuals in one table."""
    found = diagnose(event_sample(spark, sf_dir, 40).residuals(), 40, max_lag=1)
    leak = found["leakage"].where("fold = 'pooled'").select(F.lit("leakage").alias("test"), "equation", F.lit(None).cast("int").alias("lag"),
                                                             rnd("F_stat", 5, "statistic"), rnd("p_value"))
    box = found["ljung_box"].select(F.lit("ljung_box"), "equation", "lag", rnd("lb_stat", 5, "statistic"), rnd("lb_pvalue", 6, "p_value"))
    return leak.union(box)


@query("diagnose_weekly")
def diagnose_weekly(spark, sf_dir):
    """Leakage and autocorrelation tests of both residuals of a wide weekly sample."""
    found = diagnose(wide_weekly(spark, sf_dir, lags=2).residuals(outcome=Learner("ridge", 1.0), policy=Learner("ridge", 1.0)), 6)
    leak = found["leakage"].select("equation", F.lit("leakage").alias("test"), F.col("fold").alias("part"),
                                   rnd("F_stat", 6, "statistic"), rnd("p_value"))
    box = found["ljung_box"].select("equation", F.lit("ljung_box").alias("test"), F.col("lag").cast("string").alias("part"),
                                    rnd("lb_stat", 6, "statistic"), rnd("lb_pvalue", 6, "p_value"))
    return leak.unionByName(box)


@query("tuned_irf_weekly_wide")
def tuned_irf(spark, sf_dir):
    """Tune on the current outcome, reuse the learners for nine horizons, cumulate, estimate."""
    sample = wide_weekly(spark, sf_dir, horizons=8)
    gram = sample.gram()
    tuned, _ = sample.tune([("lasso", {"penalty": penalties(1e-4, 1.0, 100)})], [("lasso", {"penalty": penalties(1e-6, 1e-3, 100)})], gram=gram)
    return _irf_out(impulse_response(sample, code=5, learners=tuned), digits=6)


_OUTCOMES = ("revenue", "qty", "n_lines", "n_returned", "avg_tax")


@query("tuned_irf_five_outcomes")
def tuned_irf_outcomes(spark, sf_dir):
    """Five outcomes as one panel: tuning, nine horizons and scaling without a loop over outcomes."""
    weekly = series.sales(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("target")) for o in _OUTCOMES]))
    rows = weekly.select("*", each.alias("_e")).select("ts", "qty", "revenue", "avg_disc", "avg_tax", "n_lines", "_e.*")
    codes = {"target": 5, "avg_disc": 2, "n_lines": 5, "avg_tax": 1, "qty": 5, "revenue": 5}
    spec = Design("ts", "target", "avg_disc", codes, fast=("n_lines", "avg_tax"), keys=("outcome",), lags=6, horizons=8)
    sample = Sample(build_design(rows, spec), tuple(feature_names(spec)), 6, ("outcome",))
    gram = sample.gram()
    tuned, _ = sample.tune([("lasso", {"penalty": penalties(1e-4, 1.0, 100)})], [("lasso", {"penalty": penalties(1e-6, 1e-3, 100)})], gram=gram)
    irf = materialize(impulse_response(sample, code=5, learners=tuned))
    return _irf_out(scale_irfs(irf, "revenue", "qty", ["avg_tax"], 0.5), "outcome", digits=5)
