"""Tuning and cross-fitting with any ``pyspark.ml`` regressor.

All candidates of both equations and all folds are fitted on one stored table of
vectors, whose samples are chosen by ``block_id``; fits run side by side, as each is a
Spark job of its own.  The candidates of a fold are scored together: one job over the
validation block adds every candidate's prediction as a column and sums up the errors.
Only error sums come to the driver, one per candidate, fold and equation.

A candidate that cannot be fitted has no error measure and a reason instead; the curve
closes over it, so windows and ranks are those of the candidates that are left.
Choice goes by the same rules as for the linear learners (``tuning.select_candidates``).

This serves one long series.  For many series see ``operators.trees`` and the linear
learners, which fit all series in the same scans.
"""

from __future__ import annotations

import itertools
import math
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.crossfit import fold_plan, lead_columns
from foldwise.operators.storage import materialize
from foldwise.operators.tuning import failed_curves, select_candidates

#: Candidates whose predictions stand side by side in one scoring job.
SIDE_BY_SIDE = 16


@dataclass(frozen=True)
class Candidate:
    """An estimator, its kind, and the parameters that set it apart."""

    estimator: object
    kind: str
    params: dict


def expand_library_grid(estimator, params: dict[str, list] | None = None) -> list[Candidate]:
    """All combinations, parameters in name order, the last one fastest; none gives the estimator as it is."""
    names = sorted(params or {})
    out = []
    for values in itertools.product(*[params[n] for n in names]) if names else [()]:
        given = dict(zip(names, values))
        out.append(Candidate(estimator.copy({estimator.getParam(n): v for n, v in given.items()}), type(estimator).__name__, given))
    return out


def library_candidates(given) -> list[Candidate]:
    """A grid from estimators, ``(estimator, params)`` pairs, candidates, or a mix of them."""
    out: list[Candidate] = []
    for item in given:
        out += [item] if isinstance(item, Candidate) else expand_library_grid(*(item if isinstance(item, tuple) else (item,)))
    if not out:
        raise ValueError("the grid is empty")
    return out


def vector_table(design: DataFrame, features, time_col: str = "ts") -> DataFrame:
    """The rows of all blocks, stored: ``time, pos, n_rows, block_id, features`` (a vector), ``d`` and the leads."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_features").transform(design.where(F.col("block_id").isNotNull()))
    return materialize(rows.select(time_col, "pos", "n_rows", "block_id", F.col("_features").alias("features"), "d", *lead_columns(design)))


def _fit(rows: DataFrame, estimator, target: str, blocks):
    learner = estimator.copy({estimator.labelCol: target, estimator.featuresCol: "features"})
    return learner.fit(rows.where(F.col("block_id").isin([int(b) for b in blocks])))


def _predicted(rows: DataFrame, model, name: str) -> DataFrame:
    return model.copy({model.predictionCol: name}).transform(rows)


def _reason(error: Exception) -> str:
    lines = [x for x in str(error).splitlines() if x.strip()]
    return f"{type(error).__name__}: {lines[0] if lines else ''}"[:300]


def _together(jobs, parallelism: int):
    """Results of functions without arguments, in their order."""
    with ThreadPoolExecutor(max(parallelism, 1)) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(job)(), jobs))


def library_profile(rows: DataFrame, outcome_grid, policy_grid, n_blocks: int, fold_design: str = "rcf", horizon: int = 0,
                    parallelism: int = 4) -> DataFrame:
    """Validation RMSE of every candidate on a ``vector_table``: ``fold, equation, grid_idx, kind, params, rmse, error, n_train, n_val, n_rows``.

    A candidate that failed, or whose error is not finite, has no ``rmse`` but an ``error``.
    """
    spark, grids = rows.sparkSession, {"outcome": library_candidates(outcome_grid), "policy": library_candidates(policy_grid)}
    targets, plan = {"outcome": f"lead{horizon}", "policy": "d"}, fold_plan(spark, n_blocks, fold_design)
    sizes = {r["block_id"]: r["n"] for r in rows.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per block
    n_rows = rows.agg(F.max("n_rows")).first()[0]
    cases = []
    for step in plan:
        if not step["train"]:
            raise ValueError(f"fold {step['fold']}: no training rows are left beside the validation block")
        cases += [(step, equation, i) for equation in ("outcome", "policy") for i in range(len(grids[equation]))]

    def fitted(step, equation, i):
        try:
            return _fit(rows, grids[equation][i].estimator, targets[equation], step["train"])
        except Exception as error:  # whatever an estimator or its tasks raise is the candidate's failure
            return _reason(error)

    models = _together([lambda c=c: fitted(*c) for c in cases], parallelism)

    def scored(step, part):
        """Mean squared errors of some fitted candidates of a fold, from one pass over its validation block."""
        pieces = rows.where(F.col("block_id") == step["validate"])
        for k in part:
            pieces = _predicted(pieces, models[k], f"_p{k}")
        miss = lambda k: F.col(targets[cases[k][1]]) - F.col(f"_p{k}")
        return pieces.agg(*[F.avg(miss(k) * miss(k)).alias(f"m{k}") for k in part]).first()

    def score(step, part):
        try:
            return dict(zip(part, scored(step, part)))
        except Exception:  # find the one that cannot predict
            out = {}
            for k in part:
                try:
                    out[k] = scored(step, [k])[0]
                except Exception as error:
                    models[k] = _reason(error)
            return out

    jobs = []
    for step in plan:
        mine = [k for k, c in enumerate(cases) if c[0]["fold"] == step["fold"] and not isinstance(models[k], str)]
        jobs += [lambda s=step, p=mine[a:a + SIDE_BY_SIDE]: score(s, p) for a in range(0, len(mine), SIDE_BY_SIDE)]
    errors: dict = {}
    for found in _together(jobs, parallelism):
        errors.update(found)
    table = []
    for k, (step, equation, i) in enumerate(cases):
        value, why = errors.get(k), models[k] if isinstance(models[k], str) else None
        if why is None and (value is None or not math.isfinite(value)):
            value, why = None, "the validation error is not finite"
        c = grids[equation][i]
        table.append((step["fold"], equation, i, c.kind, {n: str(v) for n, v in c.params.items()}, None if value is None else math.sqrt(value), why,
                      sum(sizes.get(b, 0) for b in step["train"]), sizes.get(step["validate"], 0), n_rows))
    return spark.createDataFrame(table, "fold int, equation string, grid_idx int, kind string, params map<string, string>, rmse double, error string, "
                                        "n_train bigint, n_val bigint, n_rows bigint")


def failed_candidates(profile: DataFrame) -> DataFrame:
    """The candidates that took no part in the choice, with the reason."""
    return profile.where(F.col("rmse").isNull()).select("fold", "equation", "grid_idx", "kind", "params", "error")


def select_library(profile: DataFrame, rule: str = "goldilocks_zone", window: int = 3) -> DataFrame:
    """One candidate per fold and equation by a rule of ``tuning``.

    Candidates that failed are left out with a warning; a curve on which all failed is an error.
    """
    empty = [(r["fold"], r["equation"]) for r in failed_curves(profile).orderBy("fold", "equation").collect()]  # at most two per fold
    if empty:
        why = failed_candidates(profile).orderBy("fold", "equation", "grid_idx").first()
        raise ValueError(f"every candidate failed on {empty}, the first with {why['error']!r}")
    for r in failed_candidates(profile).groupBy("equation").agg(F.countDistinct("grid_idx").alias("n"), F.count(F.lit(1)).alias("fits")).orderBy("equation").collect():
        warnings.warn(f"{r['n']} {r['equation']} candidates failed in {r['fits']} fits and were left out of the curves", stacklevel=2)
    return select_candidates(profile, rule, window)


def chosen_estimators(tuned: DataFrame, grid, equation: str, n_blocks: int) -> list:
    """The chosen estimator of each fold."""
    at = {r["fold"]: r["grid_idx"] for r in tuned.where(F.col("equation") == equation).select("fold", "grid_idx").collect()}
    cases = library_candidates(grid)
    return [cases[at[k]].estimator for k in range(n_blocks)]


def crossfit_library(rows: DataFrame, outcome, policy, n_blocks: int, fold_design: str = "rcf", time_col: str = "ts", parallelism: int = 4) -> DataFrame:
    """Residuals of the policy and of every lead of a ``vector_table``: ``time, pos, n_rows, block_id, xi, chi0..chiH``.

    ``policy`` and ``outcome`` are an estimator or one per fold; ``outcome`` may also be a
    dict of these by horizon.  The policy is fitted once for all leads; the two sides of a
    central fold are averaged.
    """
    leads, plan = lead_columns(rows), fold_plan(rows.sparkSession, n_blocks, fold_design)
    if isinstance(outcome, dict) and set(outcome) != set(range(len(leads))):
        raise ValueError(f"outcome learners for horizons {sorted(outcome)}; the sample has 0 to {len(leads) - 1}")

    def learner(target: str, fold: int):
        given = policy if target == "d" else outcome[int(target[4:])] if isinstance(outcome, dict) else outcome
        return given[fold] if isinstance(given, (list, tuple)) else given

    cases = [(step["fold"], target, tuple(side)) for step in plan for target in ("d", *leads) for side in step["sides"]]
    models = _together([lambda c=c: _fit(rows, learner(c[1], c[0]), c[1], c[2]) for c in cases], parallelism)
    found = None
    for step in plan:
        pieces, hats = rows.where(F.col("block_id") == step["fold"]), {}
        for k, (fold, target, _) in enumerate(cases):
            if fold == step["fold"]:
                hats.setdefault(target, []).append(f"_p{k}")
                pieces = _predicted(pieces, models[k], f"_p{k}")
        left = lambda target: F.col(target) - sum((F.col(n) for n in hats[target][1:]), F.col(hats[target][0])) / len(hats[target])
        part = pieces.select(time_col, "pos", "n_rows", "block_id", left("d").alias("xi"), *[left(c).alias(f"chi{h}") for h, c in enumerate(leads)])
        found = part if found is None else found.unionByName(part)
    return materialize(found)


def tuned_crossfit_library(rows: DataFrame, outcome_grid, policy_grid, n_blocks: int, rule: str = "goldilocks_zone", window: int = 3, fold_design: str = "rcf",
                           time_col: str = "ts", parallelism: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(residuals, tuned, profile)``: candidates chosen per fold on the one-sided split, then fitted on the whole training sample."""
    profile = library_profile(rows, outcome_grid, policy_grid, n_blocks, parallelism=parallelism)
    tuned = select_library(profile, rule, window)
    learners = [chosen_estimators(tuned, grid, name, n_blocks) for grid, name in ((outcome_grid, "outcome"), (policy_grid, "policy"))]
    return crossfit_library(rows, *learners, n_blocks, fold_design, time_col, parallelism), tuned, profile
