"""Histogram trees beside a plain recursive tree; tuning and cross-fitting with learners of the Spark library."""

import random
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import foldwise.operators.trees as trees_module
from foldwise.operators.crossfit import fold_plan
from foldwise.operators.design import simple_design
from foldwise.operators.library import (
    crossfit_library, expand_library_grid, failed_candidates, library_profile, select_library, tuned_crossfit_library, vector_table)
from foldwise.operators.trees import best_splits, binned, crossfit_trees, crossfit_tuned_trees, grow, tree_profile
from foldwise.operators.trees import Model
from foldwise.operators.tuning import select_candidates
from foldwise.plans.spec import TreeLearner


def plain_tree(codes, y, depth, min_rows, bins):
    """A function from codes to leaf means, by trying every split of every node."""
    best = None
    if depth and len(y) >= 2 * min_rows:
        for f in range(codes.shape[1]):
            for cut in range(bins - 1):
                left = codes[:, f] <= cut
                n, m = left.sum(), (~left).sum()
                if n >= min_rows and m >= min_rows and n and m:
                    parts = y[left].sum() ** 2 / n + y[~left].sum() ** 2 / m
                    gain = parts - y.sum() ** 2 / len(y)
                    if gain > 1e-9 * parts and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, cut
    if best is None:
        return lambda c: np.full(len(c), y.mean())
    _, f, cut = best
    left = codes[:, f] <= cut
    low, high = (plain_tree(codes[s], y[s], depth - 1, min_rows, bins) for s in (left, ~left))
    return lambda c: np.where(c[:, f] <= cut, low(c), high(c))


def plain_boosted(codes, y, learner, bins):
    fits, left = [], y.copy()
    for _ in range(learner.rounds):
        tree = plain_tree(codes, left, learner.depth, learner.min_rows, bins)
        fits.append(tree)
        left = left - learner.rate * tree(codes)
    return lambda c: sum(learner.rate * t(c) for t in fits)


def sample_rows(n, seed, features=3):
    r = random.Random(seed)
    rows, last = [], 0.0
    for t in range(n):
        x = [r.gauss(0, 1) for _ in range(features - 1)] + [float(r.randrange(3))]
        d = (x[0] > 0) * 1.5 + r.gauss(0, 1)
        last = 0.4 * last + d + (x[0] > 0.5) * 2 - (x[1] > 0) + r.gauss(0, 0.5)
        rows.append((t, last, d, *x))
    return rows


def plain_residuals(rows, leads, k, bins, learner, plan):
    a = np.array([r[1:] for r in rows], dtype=float)
    n = len(a) - leads + 1
    d, x = a[:n, 1], a[:n, 2:]
    ys = [a[h:n + h, 0] for h in range(leads)]
    size = n // k
    block = np.minimum(np.arange(n) // size, k)
    inside = block < k
    low, high = x[inside].min(0), x[inside].max(0)
    flat = high <= low
    codes = np.clip(np.floor((x - low) / np.where(flat, 1, high - low) * bins), 0, bins - 1).astype(int)
    codes[:, flat] = 0
    out = np.full((n, leads + 1), np.nan)
    for step in plan:
        main = block == step["fold"]
        for j, target in enumerate([d, *ys]):
            y = target - target[inside].mean()
            fits = []
            for side in step["sides"]:
                train = np.isin(block, side)
                fits.append(plain_boosted(codes[train], y[train], learner, bins)(codes[main]))
            out[main, j] = y[main] - np.mean(fits, axis=0)
    return out[inside]


def panel(spark, series, leads, k, parts=5):
    flat = [(name, *r, *[rows[i + h][1] if i + h < len(rows) else None for h in range(1, leads)]) for name, rows in series.items() for i, r in enumerate(rows)]
    random.Random(1).shuffle(flat)
    width = len(flat[0]) - 4 - (leads - 1)
    names = ["series", "ts", "y", "p", *[f"f{j}" for j in range(width)], *[f"y{h}" for h in range(1, leads)]]
    frame = spark.createDataFrame(flat, ", ".join(f"{n} {'string' if n == 'series' else 'long' if n == 'ts' else 'double'}" for n in names)).repartition(parts)
    sizes = {name: len(rows) - leads + 1 for name, rows in series.items()}
    frame = frame.where(F.expr(" or ".join(f"series = '{n}' and ts < {s}" for n, s in sizes.items())))
    frame = frame.withColumn("pos", F.col("ts")).withColumn("n_rows", F.expr("case " + " ".join(f"when series = '{n}' then {s}" for n, s in sizes.items()) + " end").cast("long"))
    features = [f"f{j}" for j in range(width)]
    return simple_design(frame, "y", "p", features, k, ("series",), "ts", ["y", *[f"y{h}" for h in range(1, leads)]]), features


@pytest.mark.parametrize("learner, k, design", [
    (TreeLearner(1, 1, 1.0, 2), 4, "rcf"), (TreeLearner(3, 1, 1.0, 4), 5, "rcf"), (TreeLearner(2, 3, 0.4, 3), 4, "nlo")])
def test_panel_of_trees_equals_plain_trees(spark, monkeypatch, learner, k, design):
    monkeypatch.setattr("foldwise.operators.trees.FLUSH_DOUBLES", 500)
    monkeypatch.setattr("foldwise.operators.trees.PACK_ROWS", 7)
    series = {"a": sample_rows(83, 1), "b": sample_rows(300, 2), "c": [(t, y, p, 1.0, x1, x2) for t, y, p, _, x1, x2 in sample_rows(60, 3)]}
    rows, features = panel(spark, series, 3, k)
    data = binned(rows, features, ("series",), "ts", 8, chunk_rows=50)
    got = crossfit_trees(data, learner, learner, k, design).orderBy("series", "pos").collect()
    plan = fold_plan(spark, k, design)
    for name, own in series.items():
        want = plain_residuals(own, 3, k, 8, learner, plan)
        mine = np.array([[r["xi"], r["chi0"], r["chi1"], r["chi2"]] for r in got if r["series"] == name])
        assert [r["pos"] for r in got if r["series"] == name] == list(range(len(want)))
        np.testing.assert_allclose(mine, want, atol=1e-9)


def test_learners_per_fold_and_tuned_per_series(spark):
    series = {"a": sample_rows(90, 4), "b": sample_rows(120, 5)}
    rows, features = panel(spark, series, 1, 4)
    data = binned(rows, features, ("series",), "ts", 8)
    grid = [TreeLearner(1, 1, 1.0, 3), TreeLearner(2, 1, 1.0, 3), TreeLearner(1, 3, 0.5, 3)]
    profile = tree_profile(data, grid, grid[:2], 4).collect()
    assert len(profile) == 2 * 4 * 5
    plan = {s["fold"]: s for s in fold_plan(spark, 4, "rcf")}
    want = {}
    for name, own in series.items():
        a = np.array([r[1:] for r in own])
        block = np.arange(len(a)) // (len(a) // 4)
        inside = block < 4
        low, high = a[inside, 2:].min(0), a[inside, 2:].max(0)
        codes = np.clip(np.floor((a[:, 2:] - low) / (high - low) * 8), 0, 7).astype(int)
        for fold, step in plan.items():
            train, val = np.isin(block, step["train"]), block == step["validate"]
            for equation, j, use in (("outcome", 0, grid), ("policy", 1, grid[:2])):
                y = a[:, j] - a[inside, j].mean()
                for i, m in enumerate(use):
                    miss = y[val] - plain_boosted(codes[train], y[train], m, 8)(codes[val])
                    want[name, fold, equation, i] = np.sqrt(np.mean(miss ** 2)), train.sum(), val.sum()
    for r in profile:
        rmse, n_train, n_val = want[r["series"], r["fold"], r["equation"], r["grid_idx"]]
        assert abs(r["rmse"] - rmse) < 1e-9 and (r["n_train"], r["n_val"]) == (n_train, n_val)
    tuned = select_candidates(spark.createDataFrame(profile), "rmse", keys=["series"])
    got = {(r["series"], r["pos"]): r for r in crossfit_tuned_trees(data, tuned, 4).collect()}
    pick = {(r["series"], r["fold"], r["equation"]): r["grid_idx"] for r in tuned.collect()}
    each = [crossfit_trees(data, m, m, 4).collect() for m in grid]
    for i, found in enumerate(each):
        for r in found:
            for equation, c in (("outcome", "chi0"), ("policy", "xi")):
                if pick[r["series"], r["block_id"], equation] == i:
                    assert abs(got[r["series"], r["pos"]][c] - r[c]) < 1e-9
    assert len(got) == len(each[0])


def test_splits_break_ties_by_feature_and_bin(spark):
    sums = [("m", 0, 1, f, b, n, s) for f, b, n, s in [(0, 0, 2.0, 0.0), (0, 3, 2.0, 8.0), (1, 0, 2.0, 0.0), (1, 1, 2.0, 8.0)]]
    frame = spark.createDataFrame(sums, "series string, model int, node int, feature int, bin int, n double, s double")
    limits = spark.createDataFrame([(0, 2)], "model int, min_rows int")
    r = best_splits(frame, limits, ("series",)).first()
    assert (r["feature"], r["cut"], r["n"], r["s"], r["n_left"], r["s_left"]) == (0, 0, 4.0, 8.0, 2.0, 0.0)
    assert best_splits(frame, spark.createDataFrame([(0, 3)], "model int, min_rows int"), ("series",)).first()["feature"] is None
    with pytest.raises(ValueError, match="bins"):
        binned(frame, ["n"], bins=1000)


def single(spark, n=120, leads=2):
    rows, features = panel(spark, {"a": sample_rows(n, 9)}, leads, 4)
    return rows.drop("series"), features


def test_trees_of_one_series_have_one_scan_per_level(spark):
    rows, features = single(spark)
    data = binned(rows, features, bins=8)
    models = [Model(0, 1, frozenset([1, 2]), TreeLearner(2, 1, 1.0, 3)), Model(1, 0, frozenset([0]), TreeLearner(1, 2, 0.5, 3))]
    nodes = grow(data, models).collect()
    assert {(r["model"], r["round"]) for r in nodes} == {(0, 0), (1, 0), (1, 1)}
    assert {r["node"] for r in nodes if r["model"] == 1} == {1, 2, 3}
    assert all((r["feature"] >= 0) == (r["node"] < 4) for r in nodes if r["model"] == 0)


def test_library_learners_choice_failures_and_leads(spark):
    from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression, LinearRegression

    rows, features = single(spark)
    table = vector_table(rows, features)
    line = LinearRegression(solver="normal")
    bad = GeneralizedLinearRegression(family="poisson")
    grid = [bad, (line, {"regParam": [0.0, 0.1]}), DecisionTreeRegressor(maxDepth=2, seed=1)]
    profile = library_profile(table, grid, [(line, {"regParam": [0.0, 0.2]}), line], 4)
    found = profile.collect()
    assert len(found) == 4 * (4 + 3) and {r["grid_idx"] for r in found if r["rmse"] is None} == {0}
    failed = failed_candidates(profile).collect()
    assert len(failed) == 4 and all(r["error"] and r["equation"] == "outcome" for r in failed)
    with pytest.warns(UserWarning, match="1 outcome candidates failed in 4 fits"):
        tuned = select_library(profile, "rmse").collect()
    for r in tuned:
        best = min((x["rmse"], x["grid_idx"]) for x in found if (x["fold"], x["equation"]) == (r["fold"], r["equation"]) and x["rmse"] is not None)
        assert r["grid_idx"] == best[1]
    with pytest.raises(ValueError, match="every candidate failed"):
        select_library(library_profile(table, [bad], [line], 4))
    with warnings.catch_warnings(record=True) as told:
        out, _, _ = tuned_crossfit_library(table, [line], [line], 4)
    assert not [w for w in told if "candidates" in str(w.message)]
    a = np.array([r[1:] for r in sample_rows(120, 9)])
    n = 119
    block = np.arange(n) // (n // 4)
    got = {r["pos"]: r for r in out.collect()}
    for step in fold_plan(spark, 4, "rcf"):
        train, main = np.isin(block, step["sides"][0]), np.flatnonzero(block == step["fold"])
        x = np.column_stack([np.ones(n), a[:n, 2:]])
        for name, y in (("xi", a[:n, 1]), ("chi0", a[:n, 0]), ("chi1", a[1:n + 1, 0])):
            beta = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
            np.testing.assert_allclose([got[p][name] for p in main], (y - x @ beta)[main], atol=1e-7)
    with pytest.raises(ValueError, match="horizons"):
        crossfit_library(table, {0: line}, line, 4)
    assert [c.params for c in expand_library_grid(line, {"regParam": [1.0, 2.0], "maxIter": [5]})] == [{"maxIter": 5, "regParam": 1.0}, {"maxIter": 5, "regParam": 2.0}]


def test_short_series_leave_a_task_in_few_batches():
    """Sums and residuals of many short series are handed over together, not a batch for each."""
    schema = pa.schema([("k", pa.string()), ("n", pa.float64()), ("s", pa.float64())])
    sums = trees_module._Sums(schema, lambda ids, v: [*ids, v[:, 0], v[:, 1]] if isinstance(v, np.ndarray) and v.ndim == 2 else [[x] for x in (*ids, *v)])
    for k in range(5000):
        assert not list(sums.add((f"u{k % 2500}",), np.array([1.0, k])))
    got = list(sums.rest())
    assert len(got) <= 2 and sum(b.num_rows for b in got) == 2500
    rows = {r["k"]: (r["n"], r["s"]) for b in got for r in b.to_pylist()}
    assert rows == {f"u{k}": (2.0, 2.0 * k + 2500) for k in range(2500)}
    small = [pa.RecordBatch.from_pydict({"k": ["a"], "n": [float(k)], "s": [0.0]}, schema=schema) for k in range(3000)]
    merged = list(trees_module._merged(iter(small)))
    assert len(merged) == 1 and merged[0].column(1).to_pylist() == [float(k) for k in range(3000)] and not list(trees_module._merged(iter([])))
