"""Penalty choice per fold: validation curves from block sums, then a selection rule."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.crossfit import added, fold_plan, fold_tasks, predicted, spread, with_features
from foldwise.operators.learners import KINDS, squared_error, unshifted, weights
from foldwise.operators.storage import CHUNK_ROWS, attach, materialize
from foldwise.plans.spec import Learner

#: Digits of a window's score (0 to 2): windows of the same errors in another order are ties, and the first one wins.
SCORE_DIGITS = 12

RULES = {"rmse": "least_error", "predictive": "least_error", "goldilocks": "stability",
         "goldilocks_zone": "stability", "gz": "stability", "stability": "stability"}


def rule_named(name: str) -> str:
    key = name.lower().replace("-", "_")
    if key not in RULES:
        raise ValueError(f"unknown tuning rule {name!r}; known: {sorted(RULES)}")
    return RULES[key]


def expand_grid(kind: str, params: dict[str, list]) -> list[Learner]:
    """All combinations, parameters in name order, the last one fastest."""
    if kind not in KINDS:
        raise ValueError(f"unknown learner {kind!r}; known: {KINDS}")
    names = sorted(params)
    return [Learner(kind, **dict(zip(names, values))) for values in itertools.product(*[params[n] for n in names])]


def candidates(given) -> list[Learner]:
    """A grid from learners, ``(kind, params)`` pairs, or a mix of both."""
    out: list[Learner] = []
    for item in given:
        out += [item] if isinstance(item, Learner) else expand_grid(*item)
    if not out:
        raise ValueError("the grid is empty")
    return out


def _tuning_plan(spark, n_blocks: int, design: str):
    plan = fold_plan(spark, n_blocks, design)
    for r in plan:
        if not r["train"]:
            raise ValueError(f"fold {r['fold']}: no training rows are left beside the validation block")
    return plan


def error_profile(gram: DataFrame, outcome_grid, policy_grid, n_features: int, horizons: int, n_blocks: int,
                  design: str = "rcf", keys=(), return_coef: bool = False) -> DataFrame:
    """Validation RMSE of every candidate: ``keys, fold, equation, grid_idx, kind,
    penalty, l1_share, rmse, n_train, n_val``; a failed candidate has no RMSE."""
    keys = list(keys)
    plan = _tuning_plan(gram.sparkSession, n_blocks, design)
    split = {r["fold"]: (list(r["train"]), [r["validate"]]) for r in plan}
    grids = {"outcome": candidates(outcome_grid), "policy": candidates(policy_grid)}
    width, p = n_features + 2 + horizons + 1, n_features
    tasks = fold_tasks(gram, plan, keys, ("outcome", "policy"))

    def curve(row, fold, equation):
        target = p + 2 if equation == "outcome" else p + 1
        (train, level), (val, near) = (added(row, s, width) for s in split[fold])
        grid = grids[equation]
        rmse, lines = [None] * len(grid), [None] * len(grid)
        start, family = None, None
        # Large penalties first: each solution starts the next one.
        for i in sorted(range(len(grid)), key=lambda i: (grid[i].kind, grid[i].l1_share, -grid[i].penalty)):
            m = grid[i]
            if family != (m.kind, m.l1_share):
                start, family = None, (m.kind, m.l1_share)
            try:
                beta = weights(train, p, target, m.kind, m.penalty, m.l1_share, level, start)
            except np.linalg.LinAlgError:
                continue
            start = beta[1:]
            line = unshifted(beta, level, p, target)
            value = float(np.sqrt(squared_error(val, near, p, target, line) / val[0, 0]))
            if np.isfinite(value):
                rmse[i], lines[i] = value, line
        frame = pd.DataFrame({
            "fold": fold, "equation": equation, "grid_idx": range(len(grid)),
            "kind": [m.kind for m in grid], "penalty": [float(m.penalty) for m in grid],
            "l1_share": [float(m.l1_share) for m in grid], "rmse": pd.array(rmse, dtype="Float64"),
            "n_train": int(round(train[0, 0])), "n_val": int(round(val[0, 0])), "n_rows": row.n_rows})
        if return_coef:
            frame["coef"] = lines
        for k in keys:
            frame[k] = getattr(row, k)
        return frame

    def score(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.concat([curve(row, f, e) for f in row.folds for e in row.equations], ignore_index=True)

    types = {f.name: f.dataType.simpleString() for f in gram.schema.fields}
    schema = ", ".join([
        *[f"`{k}` {types[k]}" for k in keys], "fold int", "equation string", "grid_idx int", "kind string",
        "penalty double", "l1_share double", "rmse double", "n_train bigint", "n_val bigint", "n_rows bigint",
        *(["coef array<double>"] if return_coef else [])])
    return spread(tasks).mapInPandas(score, schema)


def custom_profile(design: DataFrame, gram: DataFrame, outcome_grid, policy_grid, features, metric, n_blocks: int,
                   fold_design: str = "rcf", keys=(), horizons: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The profile under any metric: ``metric(y, fitted)`` is an aggregate Column, smaller is better.

    Reads the validation rows once, with every candidate of their fold side by side.
    """
    keys = list(keys)
    base = materialize(error_profile(gram, outcome_grid, policy_grid, len(features), horizons, n_blocks,
                                     fold_design, keys, return_coef=True).where("rmse is not null"))
    plan = _tuning_plan(design.sparkSession, n_blocks, fold_design)
    near = F.create_map(*[F.lit(v) for r in plan for v in (r["fold"], r["validate"])])
    lines = base.select(*keys, "n_rows", "fold", "equation", "grid_idx", "coef", near[F.col("fold")].alias("block_id"))
    sets = lines.groupBy(*keys, "n_rows", "block_id").agg(
        F.collect_list(F.struct("fold", "equation", "grid_idx", "coef")).alias("_all"))
    rows = with_features(design.where(F.col("block_id").isNotNull()), features, 1)
    x = ["_x"] if "_x" in rows.columns else list(features)
    rows = attach(rows, materialize(sets), keys, ["block_id"], chunk_rows)
    each = rows.select(*keys, "y", "d", *x, F.explode("_all").alias("_m")).select(
        *keys, "_m.fold", "_m.equation", "_m.grid_idx",
        F.when(F.col("_m.equation") == "outcome", F.col("y")).otherwise(F.col("d")).alias("_y"),
        predicted(features, F.col("_m.coef"), 1).alias("_fit"))
    scores = each.groupBy(*keys, "fold", "equation", "grid_idx").agg(metric(F.col("_y"), F.col("_fit")).alias("rmse"))
    return base.drop("rmse", "coef").join(scores, [*keys, "fold", "equation", "grid_idx"])


def _ranked(profile: DataFrame, by) -> tuple[DataFrame, Window, Window]:
    order = Window.partitionBy(*by).orderBy("grid_idx")
    whole = Window.partitionBy(*by)
    ranked = profile.where(F.col("rmse").isNotNull()).withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(whole))
    return ranked, order, whole


def _normal(value: Column, whole: Window) -> Column:
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    return F.when(high - low > 1e-10, (value - low) / (high - low)).otherwise(0.0)


def stability_curve(profile: DataFrame, window: int = 3, by=("fold", "equation")) -> DataFrame:
    """The curve with its scored windows, the chosen window and both minima.

    Failed candidates are left out first, so windows close over them.  Each curve
    has one row per candidate, so windows by curve stay small.
    """
    by = list(by)
    ranked, order, whole = _ranked(profile, by)
    frame = order.rowsBetween(0, window - 1)
    full = F.col("_i") <= F.col("_n") - window
    scored = (ranked.withColumn("window_mean", F.when(full, F.avg("rmse").over(frame)))
              .withColumn("window_var", F.when(full, F.var_pop("rmse").over(frame))))
    scored = scored.withColumn("window_score", F.when(
        full, F.round(_normal(F.col("window_var"), whole) + _normal(F.col("window_mean"), whole), SCORE_DIGITS)))
    first = F.min(F.when(full, F.struct("window_score", "_i"))).over(whole)["_i"]
    scored = scored.withColumn("_start", F.when(F.col("_n") > 1, first))
    inside = F.col("_start").isNull() | F.col("_i").between(F.col("_start"), F.col("_start") + window - 1)
    scored = scored.withColumn("in_window", inside)
    chosen = F.min(F.when(F.col("in_window"), F.struct("rmse", "_i"))).over(whole)["_i"]
    lowest = F.min(F.struct("rmse", "_i")).over(whole)["_i"]
    return scored.withColumn("is_chosen", F.col("_i") == chosen).withColumn("is_lowest", F.col("_i") == lowest).withColumn(
        "at_edge", F.col("_i") == F.col("_n") - 1).drop("_i", "_n", "_start")


def stability_select(profile: DataFrame, window: int = 3, by=("fold", "equation")) -> DataFrame:
    """The chosen candidate of each curve: lowest error inside the steadiest low window."""
    return stability_curve(profile, window, by).where("is_chosen").drop("is_chosen", "in_window")


def least_error_select(profile: DataFrame, by=("fold", "equation")) -> DataFrame:
    """The first candidate with the lowest error."""
    ranked, _, whole = _ranked(profile, list(by))
    lowest = F.min(F.struct("rmse", "_i")).over(whole)["_i"]
    return ranked.where(F.col("rmse").isNotNull()).withColumn("_low", lowest).where("_i = _low").withColumn(
        "at_edge", F.col("_i") == F.col("_n") - 1).drop("_i", "_n", "_low")


def select_candidates(profile: DataFrame, rule: str = "goldilocks_zone", window: int = 3, keys=()) -> DataFrame:
    """``tuned``: one candidate per key, fold and equation, ready for ``crossfit``."""
    by = [*keys, "fold", "equation"]
    if rule_named(rule) == "stability":
        return stability_select(profile, window, by)
    return least_error_select(profile, by)


def failed_curves(profile: DataFrame, keys=()) -> DataFrame:
    """Curves on which every candidate failed; nothing can be chosen there."""
    return profile.groupBy(*keys, "fold", "equation").agg(F.count("rmse").alias("n_ok")).where("n_ok = 0")


def selected_params(tuned: DataFrame, keys=()) -> DataFrame:
    """One row per fold with the choice of both equations side by side."""
    picks = []
    for equation in ("outcome", "policy"):
        mine = F.col("equation") == equation
        for name in ("kind", "penalty", "l1_share", "rmse", "at_edge"):
            picks.append(F.max(F.when(mine, F.col(name))).alias(f"{equation}_{name}"))
    return tuned.groupBy(*keys, "fold").agg(F.max("n_train").alias("n_train"), F.max("n_val").alias("n_val"), *picks)
