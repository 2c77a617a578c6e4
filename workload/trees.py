"""Queries on regression trees: residuals, tuning and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators.stage2 import stage2
from foldwise.operators.projections import local_projections
from foldwise.operators.storage import materialize
from foldwise.operators.trees import binned, crossfit_trees, crossfit_tuned_trees, tree_profile
from foldwise.operators.tuning import select_candidates
from foldwise.plans.spec import Inference, TreeLearner
from workload import sql
from workload.estimating import event_rows, event_sample, weekly_rows, weekly_sample
from workload.registry import query, rnd


def tree_fits(source: str, train: str, features: list[str], targets: dict[str, str], bins: int, keys: str = "", depth: int = 2, rounds: int = 1,
              rate: float = 1.0, min_rows: int = 5, name: str = "fit", also: str = "l.block = s.block_id OR l.fold = s.block_id") -> str:
    """CTEs ending in ``fit(keys, fold, side, eq, pos, block_id, y)``: what boosted trees leave of the centred targets.

    ``train`` gives ``fold, side, block``.  Rows of training blocks and rows for which ``also`` holds get a fit.
    """
    key, pull, part = (f"{keys}, ", f"s.{keys}, ", f"PARTITION BY {keys}") if keys else ("", "", "")
    on = lambda a, b: f" AND {a}.{keys} = {b}.{keys}" if keys else ""
    p = name
    code = lambda x: (f"CASE WHEN max({x}) OVER ({part}) > min({x}) OVER ({part}) THEN greatest(least(floor(({x} - min({x}) OVER ({part})) / "  # noqa: E731
                      f"(max({x}) OVER ({part}) - min({x}) OVER ({part})) * {bins})::INT, {bins - 1}), 0) ELSE 0 END")
    ys = " UNION ALL ".join(f"SELECT {key}pos, block_id, '{n}' AS eq, {e} - avg({e}) OVER ({part}) AS y FROM {p}_src" for n, e in targets.items())
    out = [f"""{p}_src AS (SELECT * FROM ({source}) WHERE block_id IS NOT NULL), {p}_tr AS ({train}), {p}_fs AS (SELECT DISTINCT fold, side FROM {p}_tr),
      {p}_codes AS (SELECT {key}pos, unnest(range({len(features)})) AS f, unnest([{', '.join(code(x) for x in features)}]) AS bin FROM {p}_src),
      {p}_y AS ({ys}),
      {p}_0_0 AS (SELECT {pull}l.fold, l.side, s.eq, s.pos, s.block_id, t.block IS NOT NULL AS train, 1 AS node, s.y FROM {p}_y s, {p}_fs l
        LEFT JOIN {p}_tr t ON t.fold = l.fold AND t.side = l.side AND t.block = s.block_id WHERE t.block IS NOT NULL OR {also.replace('l.block = s.block_id', 'false')})"""]
    mine = f"{key}fold, side, eq, node"
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("fold", "side", "eq", "node")) + on(a, b)
    last = f"{p}_0_0"
    for r in range(rounds):
        for d in range(depth):
            h, c, b = f"{p}_h{r}{d}", f"{p}_c{r}{d}", f"{p}_b{r}{d}"
            nxt = f"{p}_{r}_{d + 1}"
            out.append(f"""{h} AS (SELECT {'a.' + keys + ', ' if keys else ''}a.fold, a.side, a.eq, a.node, k.f, k.bin, count(*) AS n, sum(a.y) AS s FROM {last} a
                JOIN {p}_codes k ON k.pos = a.pos{on('k', 'a')} WHERE a.train AND a.node >= {1 << d} GROUP BY ALL),
              {c} AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY {mine}, f) AS nn, sum(s) OVER (PARTITION BY {mine}, f) AS ss FROM {h}
                WINDOW w AS (PARTITION BY {mine}, f ORDER BY bin)),
              {c}g AS (SELECT *, sl * sl / nl + (ss - sl) * (ss - sl) / (nn - nl) AS parts, sl * sl / nl + (ss - sl) * (ss - sl) / (nn - nl) - ss * ss / nn AS gain
                FROM {c} WHERE nl >= {min_rows} AND nn - nl >= {min_rows}),
              {b} AS (SELECT * FROM (SELECT *, max(gain) OVER (PARTITION BY {mine}) AS most FROM {c}g WHERE gain > 1e-9 * parts) WHERE gain >= most * (1 - 1e-9)
                QUALIFY row_number() OVER (PARTITION BY {mine} ORDER BY f, bin) = 1),
              {nxt} AS (SELECT a.* REPLACE (CASE WHEN b.node IS NULL THEN a.node ELSE 2 * a.node + (k.bin > b.bin)::INT END AS node) FROM {last} a
                LEFT JOIN {b} b ON {same('a', 'b')} LEFT JOIN {p}_codes k ON k.pos = a.pos AND k.f = b.f{on('k', 'a')})""")
            last = nxt
        leaf = f"{p}_l{r}"
        out.append(f"""{leaf} AS (SELECT {mine}, avg(y) AS v FROM {last} WHERE train GROUP BY ALL),
          {p}_{r + 1}_0 AS (SELECT a.* REPLACE (1 AS node, a.y - {rate} * l.v AS y) FROM {last} a JOIN {leaf} l ON {same('a', 'l')})""")
        last = f"{p}_{r + 1}_0"
    out.append(f"{name} AS (SELECT * FROM {last})")
    return ", ".join(out)


def _folds(k):
    return f"folds AS (SELECT unnest(range({k})) AS fold), blocks AS (SELECT unnest(range({k})) AS block)"


def tree_residuals(source: str, k: int, features, targets, bins: int, keys: str = "", design: str = "rcf", **how) -> str:
    """CTEs ending in ``resid``: what trees leave of each target in its own fold, sides averaged."""
    key = f"{keys}, " if keys else ""
    outs = ", ".join(f"avg(CASE WHEN eq = '{n}' THEN y END) AS {n}" for n in targets)
    return f"""{_folds(k)}, {tree_fits(source, sql.trains(design, k), features, targets, bins, keys, **how)},
      resid AS (SELECT {key}pos, block_id, {outs} FROM fit WHERE fold = block_id GROUP BY {key}pos, block_id)"""


def _binned(sample, bins):
    return binned(sample.rows, sample.features, sample.keys, sample.time_col, bins, sample.chunk_rows)


def _off_ties(name):
    """Rounded a little off: leaf means of cents often lie just between two roundings."""
    return F.round(F.col(name) + 3e-9, 6).alias(name)


_ONE = {"chi0": "value", "xi": "k"}


def _residual_query(name, k, bins, learner, design="rcf"):
    how = {"depth": learner.depth, "rounds": learner.rounds, "rate": learner.rate, "min_rows": learner.min_rows}

    @query(name, f"WITH {tree_residuals(weekly_rows(k), k, ['x', 'x2'], _ONE, bins, design=design, **how)} SELECT pos, block_id, round(chi0, 5) AS chi0, round(xi, 7) AS xi FROM resid")
    def run(spark, sf_dir):
        sample = weekly_sample(spark, sf_dir, k, design)
        out = crossfit_trees(_binned(sample, bins), learner, learner, k, design)
        return out.select("pos", "block_id", rnd("chi0", 5), rnd("xi", 7))


_residual_query("tree_stump_weekly", 6, 16, TreeLearner(depth=1, min_rows=3))
_residual_query("tree_depth2_weekly", 5, 16, TreeLearner(depth=2, min_rows=3))
_residual_query("tree_depth2_buffered_weekly", 6, 8, TreeLearner(depth=2, min_rows=4), "nlo")
_residual_query("tree_boosted_weekly", 4, 8, TreeLearner(depth=1, rounds=3, rate=0.5, min_rows=3))

_LEADS = {"chi0": "value", "chi1": "v1", "chi2": "v2", "xi": "k"}


@query("tree_leads_events", f"WITH {tree_residuals(event_rows(4, 3), 4, ['x'], _LEADS, 32, depth=2, min_rows=20)} "
       "SELECT pos, block_id, round(chi0 + 3e-9, 6) AS chi0, round(chi1 + 3e-9, 6) AS chi1, round(chi2 + 3e-9, 6) AS chi2, round(xi + 3e-9, 6) AS xi FROM resid")
def tree_leads(spark, sf_dir):
    """Three horizons and the policy at once, on every event."""
    sample = event_sample(spark, sf_dir, 4, leads=3)
    learner = TreeLearner(depth=2, min_rows=20)
    return crossfit_trees(_binned(sample, 32), learner, learner, 4).select("pos", "block_id", *[_off_ties(c) for c in _LEADS])


@query("tree_panel_users", f"WITH {tree_residuals(event_rows(4, keys='user_id'), 4, ['x'], _ONE, 8, 'user_id', depth=1, min_rows=2)} "
       "SELECT user_id, pos, block_id, round(chi0 + 3e-9, 6) AS chi0, round(xi + 3e-9, 6) AS xi FROM resid")
def tree_panel(spark, sf_dir):
    """One tree per user, fold, side and equation, all grown in the same scans."""
    sample = event_sample(spark, sf_dir, 4, keys=("user_id",))
    learner = TreeLearner(depth=1, min_rows=2)
    out = crossfit_trees(_binned(sample, 8), learner, learner, 4)
    return out.select("user_id", "pos", "block_id", _off_ties("chi0"), _off_ties("xi"))


@query("tree_effect_events", f"""WITH {tree_residuals(event_rows(6), 6, ['x'], _ONE, 16, depth=2, min_rows=10)},
  {sql.stage2_block('SELECT pos, block_id, chi0 AS chi, xi FROM resid')} SELECT round(coef, 7) AS coef, round(std_error, 7) AS std_error, n::BIGINT AS n_obs, width AS bandwidth FROM effect""")
def tree_effect(spark, sf_dir):
    """The effect with tree learners for both equations."""
    learner = TreeLearner(depth=2, min_rows=10)
    resid = crossfit_trees(_binned(event_sample(spark, sf_dir), 16), learner, learner, 6).withColumnRenamed("chi0", "chi")
    return stage2(resid, Inference()).select(rnd("coef", 7), rnd("std_error", 7), "n_obs", "bandwidth")


@query("tree_irf_users", f"""WITH {tree_residuals(event_rows(4, 3, 'user_id'), 4, ['x'], {n: e for n, e in _LEADS.items()}, 8, 'user_id', depth=1, min_rows=2)},
  long AS (SELECT user_id, pos, block_id, unnest([0, 1, 2]) AS h, unnest([chi0, chi1, chi2]) AS chi, xi FROM resid),
  fits AS (SELECT * FROM (SELECT user_id, h, block_id, regr_slope(chi, xi) AS b, regr_sxx(chi, xi) AS sxx FROM long GROUP BY ALL) WHERE sxx > 0)
  SELECT user_id, h::INT AS h, round(avg(b), 6) AS coef FROM fits GROUP BY ALL""")
def tree_irf(spark, sf_dir):
    """Impulse responses of every user over three horizons with tree learners."""
    sample = event_sample(spark, sf_dir, 4, leads=3, keys=("user_id",))
    learner = TreeLearner(depth=1, min_rows=2)
    resid = crossfit_trees(_binned(sample, 8), learner, learner, 4)
    out = local_projections(resid, Inference(), None, sample.keys, sample.time_col, sample.chunk_rows)
    return out.select("user_id", F.col("Horizon").cast("int").alias("h"), rnd("Coefficient", 6, "coef"))


# ---------------------------------------------------------------- tuning

_TREE_GRID = [TreeLearner(1, 1, 1.0, 10), TreeLearner(1, 1, 1.0, 60), TreeLearner(2, 1, 1.0, 10), TreeLearner(2, 1, 1.0, 60), TreeLearner(1, 2, 0.5, 10)]
_NEAR = "CASE WHEN fold < 3 THEN fold + 1 ELSE fold - 1 END"
_TUNE_TRAIN = f"SELECT fold, 0 AS side, block FROM ({sql.trains('rcf', 6)}) WHERE block <> {_NEAR}"


def _tree_profile_sql() -> str:
    fits, parts = [], []
    for i, g in enumerate(_TREE_GRID):
        fits.append(tree_fits(event_rows(6), _TUNE_TRAIN, ["x"], {"outcome": "value", "policy": "k"}, 16, depth=g.depth, rounds=g.rounds, rate=g.rate,
                              min_rows=g.min_rows, name=f"g{i}", also=f"s.block_id = {_NEAR.replace('fold', 'l.fold')}"))
        parts.append(f"SELECT fold::INT AS fold, eq AS equation, {i} AS grid_idx, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_val, "
                     f"sqrt(avg(y * y) FILTER (NOT train)) AS rmse FROM g{i} GROUP BY ALL")
    return f"{_folds(6)}, {', '.join(fits)}, profile AS ({' UNION ALL '.join(parts)})"


def _tree_profile(spark, sf_dir):
    data = _binned(event_sample(spark, sf_dir), 16)
    return data, materialize(tree_profile(data, _TREE_GRID, _TREE_GRID, 6))


@query("tree_profile_events", f"WITH {_tree_profile_sql()} SELECT fold, equation, grid_idx, n_train, n_val, round(rmse, 7) AS rmse FROM profile")
def profile_trees(spark, sf_dir):
    """Validation errors of a grid of trees: five candidates, two equations, six folds, grown together."""
    return _tree_profile(spark, sf_dir)[1].select("fold", "equation", "grid_idx", "n_train", "n_val", rnd("rmse", 7))


def _chosen_fits() -> str:
    """Residuals of the full training sides under every candidate; the chosen one of each fold is read."""
    fits, parts = [], []
    for i, g in enumerate(_TREE_GRID):
        fits.append(tree_fits(event_rows(6), sql.trains("rcf", 6), ["x"], {"outcome": "value", "policy": "k"}, 16, depth=g.depth, rounds=g.rounds,
                              rate=g.rate, min_rows=g.min_rows, name=f"r{i}"))
        parts.append(f"SELECT {i} AS grid_idx, fold, eq, pos, block_id, y FROM r{i} WHERE fold = block_id")
    return f"{', '.join(fits)}, fitted AS ({' UNION ALL '.join(parts)})"


@query("tuned_trees_events", f"""WITH {_tree_profile_sql()}, {_chosen_fits()},
  best AS (SELECT * FROM profile QUALIFY row_number() OVER (PARTITION BY fold, equation ORDER BY round(rmse, 12), grid_idx) = 1)
  SELECT pos, block_id, round(avg(CASE WHEN eq = 'outcome' THEN y END) + 3e-9, 6) AS chi0, round(avg(CASE WHEN eq = 'policy' THEN y END) + 3e-9, 6) AS xi
  FROM fitted f JOIN best b ON b.fold = f.fold AND b.equation = f.eq AND b.grid_idx = f.grid_idx GROUP BY pos, block_id""")
def tuned_trees(spark, sf_dir):
    """Depth, rounds and leaf size chosen per fold and equation, then grown on the whole training side."""
    data, profile = _tree_profile(spark, sf_dir)
    tuned = materialize(select_candidates(profile.withColumn("rmse", F.round("rmse", 12)), "rmse"))
    return crossfit_tuned_trees(data, tuned, 6).select("pos", "block_id", _off_ties("chi0"), _off_ties("xi"))
