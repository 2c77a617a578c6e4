"""Folds, residuals, tuning, long-run variance and effects against row-wise numpy."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import rowwise as R
from pyspark.sql import functions as F

import foldwise.operators.gram as gram_module
from foldwise.functions.dist import beta_tail, log_beta, t_quantile, t_two_sided
from foldwise.operators.crossfit import crossfit_ml, fold_plan, learner_table
from foldwise.operators.design import simple_design
from foldwise.operators.folds import check_folds, fold_membership, fold_table, sample_use
from foldwise.operators.hac import kernel_named, lrv, rule_bandwidth
from foldwise.operators.learners import descend, merged
from foldwise.operators.position import add_position
from foldwise.operators.stage2 import block_statistics, stage2
from foldwise.operators.tuning import (
    custom_profile, error_profile, expand_grid, failed_curves, least_error_select, rule_named, stability_curve, stability_select)
from foldwise.plans.analyses import Sample, static_effect, tuned_effect
from foldwise.plans.spec import Inference, Learner


def arrays(n=120, p=5, seed=0, theta=1.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 1, (n, p))
    x[:, 0] = 1.0
    d = x[:, 1] - 0.5 * x[:, 2] + rng.normal(size=n)
    return x, theta * d + x[:, 1] + rng.normal(size=n), d


def sample(spark, x, y, d, k, design="rcf", chunk=16, key=None):
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])
    pdf["y"], pdf["d"], pdf["ts"] = y, d, range(len(y))
    keys = ()
    if key is not None:
        pdf["k"], keys = key, ("k",)
        pdf["ts"] = pdf.groupby("k").cumcount()
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5)
    names = tuple(c for c in pdf if c.startswith("x"))
    rows = simple_design(add_position(df, "ts", keys), "y", "d", names, k, keys)
    return Sample(rows, names, k, keys, "ts", design, chunk)


def frame(resid):
    return resid.toPandas().sort_values("pos").reset_index(drop=True)


@pytest.mark.parametrize("k,design,learner,fit", [
    (6, "rcf", Learner(), R.ols), (5, "rcf", Learner(), R.ols), (6, "nlo", Learner(), R.ols),
    (5, "rcf", Learner("lasso", 0.1), lambda a, b: R.lasso(a, b, 0.1)),
    (4, "rcf", Learner("elastic", 0.1, 0.3), lambda a, b: R.lasso(a, b, 0.1, 0.3))])
def test_residuals_equal_row_route(spark, k, design, learner, fit):
    x, y, d = arrays(123)
    got = frame(sample(spark, x, y, d, k, design).residuals(outcome=learner, policy=learner))
    known = R.blocks(len(y), k) >= 0
    assert len(got) == known.sum()
    np.testing.assert_allclose(got["chi0"], R.cross_residuals(x, y, k, fit, design)[known], atol=1e-8)
    np.testing.assert_allclose(got["xi"], R.cross_residuals(x, d, k, fit, design)[known], atol=1e-8)


def test_numpy_sums_equal_generated_sums(spark, monkeypatch):
    x, y, d = arrays(90)
    s = sample(spark, x, y, d, 3)
    one = {r["block_id"]: r["g"] for r in s.gram().collect()}
    monkeypatch.setattr(gram_module, "MAX_SUM_COLUMNS", 1)
    two = {r["block_id"]: r["g"] for r in s.gram().collect()}
    for b in one:
        np.testing.assert_allclose(one[b], two[b], rtol=1e-12, atol=1e-10)


def test_panel_equals_loop(spark):
    x, y, d = arrays(150, 3)
    key = np.array(["a"] * 90 + ["b"] * 60)
    got = static_effect(sample(spark, x, y, d, 5, key=key)).toPandas().set_index("k")
    for name in ("a", "b"):
        m = key == name
        chi, xi = (R.cross_residuals(x[m], v[m], 5, R.ols) for v in (y, d))
        theta, se, slopes = R.stage2_block(chi, xi, 5)
        np.testing.assert_allclose(got.loc[name, ["coef", "std_error"]].astype(float), [theta, se], rtol=1e-9)
        np.testing.assert_allclose(got.loc[name, "block_coefs"], slopes, rtol=1e-9)


def test_recovers_a_known_effect(spark):
    x, y, d = arrays(400, 6, seed=4)
    grid = [("lasso", {"penalty": [0.4, 0.2, 0.1, 0.05, 0.02, 0.01]})]
    got = tuned_effect(sample(spark, x, y, d, 6), grid, grid).first()
    assert abs(got["coef"] - 1.5) < 0.15
    assert abs(got["coef"] - np.mean(got["block_coefs"])) < 1e-12


def test_profile_equals_row_route(spark):
    x, y, d = arrays(120, 4)
    s = sample(spark, x, y, d, 5)
    grid = [0.5, 0.1, 0.01]
    gram = s.gram()
    learners = [("lasso", {"penalty": grid})]
    got = error_profile(gram, learners, learners, 4, 0, 5).toPandas().set_index(["fold", "equation", "grid_idx"])["rmse"]
    mae = custom_profile(s.rows, gram, learners, learners, s.features, lambda a, f: F.avg(F.abs(a - f)), 5).toPandas().set_index(
        ["fold", "equation", "grid_idx"])["rmse"]
    block = R.blocks(120, 5)
    for plan in fold_plan(spark, 5):
        train = np.flatnonzero(np.isin(block, plan["train"]))
        val = np.flatnonzero(block == plan["validate"])
        assert plan["fold"] not in [*plan["train"], plan["validate"]]
        for eq, t in (("outcome", y), ("policy", d)):
            for i, pen in enumerate(grid):
                b, w = R.lasso(x[train], t[train], pen)
                e = t[val] - b - x[val] @ w
                assert abs(got[plan["fold"], eq, i] - np.sqrt(np.mean(e ** 2))) < 1e-8
                assert abs(mae[plan["fold"], eq, i] - np.mean(np.abs(e))) < 1e-8


def test_saturated_penalties_tie_exactly(spark):
    x, y, d = arrays(60, 3)
    grid = [("lasso", {"penalty": [50.0, 60.0, 70.0]})]
    got = error_profile(sample(spark, x, y, d, 3).gram(), grid, grid, 3, 0, 3).toPandas()
    assert (got.groupby(["fold", "equation"])["rmse"].nunique() == 1).all()


def test_library_learners(spark):
    from pyspark.ml.regression import LinearRegression

    x, y, d = arrays(60, 3)
    s = sample(spark, x, y, d, 3)
    line = LinearRegression(solver="normal")
    got = frame(crossfit_ml(s.rows, s.features, line, [line] * 3, 3))
    np.testing.assert_allclose(got["chi0"], R.cross_residuals(x, y, 3, R.ols), atol=1e-6)


def test_learner_errors(spark):
    with pytest.raises(ValueError):
        learner_table(spark, 4, [Learner()] * 3)
    x, y, d = arrays(20, 3)
    with pytest.raises(ValueError, match="no training rows"):
        sample(spark, x, y, d, 2).tune([Learner()], [Learner()])


def test_descent_with_collinear_columns():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(80, 12))
    a[:, 6:] = a[:, :6] + 1e-3 * rng.normal(size=(80, 6))
    b = a @ rng.normal(size=12) + rng.normal(size=80)
    sxx, sxy = np.cov(a.T, bias=True), (a - a.mean(0)).T @ (b - b.mean()) / 80
    for pen in (0.5, 0.05, 1e-4):
        w = descend(sxx, sxy, pen, 0.0, np.zeros(12))
        pull = sxy - sxx @ w
        on = w != 0
        np.testing.assert_allclose(pull[on], pen * np.sign(w[on]), atol=1e-7)
        assert np.all(np.abs(pull[~on]) <= pen + 1e-7)


# ---------------------------------------------------------------- folds


def test_directions_and_sides(spark):
    def way(k):
        got = {r["fold"]: r["direction"] for r in fold_table(spark, k).collect()}
        return [got[f][0] for f in range(k)]

    assert way(5) == list("rrbff") and way(6) == list("rrrfff") and way(4) == list("rrff")
    with pytest.raises(ValueError):
        check_folds(1)
    with pytest.raises(ValueError):
        check_folds(3, "nlo")
    with pytest.raises(ValueError):
        check_folds(5, "rcf", 9)


def test_membership_literals(spark):
    df = spark.range(25).select(F.col("id").alias("ts"), F.lit(1.0).alias("v"))
    rows = add_position(df, "ts", n_blocks=5)
    nlo = fold_membership(rows, 5, "nlo").where("fold = 2").toPandas()
    assert sorted(nlo[nlo.role == "main"].pos) == list(range(10, 15))
    assert sorted(nlo[nlo.role == "aux"].pos) == [*range(5), *range(20, 25)]
    rcf = fold_membership(rows, 5).where("fold = 0").toPandas()
    assert set(rcf.role) == {"main", "aux_right"} and (rcf.role == "aux_right").sum() == 20


def test_sample_use(spark):
    got = {r["K"]: r for r in sample_use(spark).collect()}
    assert [got[k]["Winner"] for k in (6, 11, 12)] == ["RCF", "tie", "NLO"]
    assert (got[6]["u_RCF"], got[6]["u_NLO"]) == (0.6667, 0.5556)


# ---------------------------------------------------------------- selection rule


@pytest.mark.parametrize("curve,window,index", [
    ([0.50, 0.20, 0.60, 0.31, 0.30, 0.31], 3, 4), ([0.9, 0.7, 0.5, 0.35, 0.30, 0.31, 0.36, 0.5], 3, 4),
    ([0.3] * 7, 3, 0), ([0.4, 0.1, 0.3], 9, 1), ([0.7], 3, 0), ([0.5, None, 0.2, 0.6, 0.31, 0.30, 0.31], 3, 5)])
def test_selection_literals(spark, curve, window, index):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(curve)], "c int, grid_idx int, rmse double")
    got = stability_select(df, window, ["c"]).first()
    assert got["grid_idx"] == index


def test_selection_tied_windows(spark):
    """Windows of the same errors in another order tie; the first one wins, whatever digits sums lose."""
    rng, window, curves = np.random.default_rng(7), 3, {}
    for c in range(800):
        curves[c] = [int(v) for v in rng.integers(101, 110, 20)]
    df = spark.createDataFrame([(c, i, v / 1000) for c, curve in curves.items() for i, v in enumerate(curve)], "c int, grid_idx int, rmse double")
    got = {r["c"]: r["grid_idx"] for r in stability_select(df, window, ["c"]).collect()}
    for c, curve in curves.items():
        means = [Fraction(sum(curve[i:i + window]), window) for i in range(len(curve) - window + 1)]
        spreads = [sum((v - m) ** 2 for v in curve[i:i + window]) for i, m in enumerate(means)]
        normal = lambda values: [(v - min(values)) / (max(values) - min(values)) for v in values]
        scores = [a + b for a, b in zip(normal(means), normal(spreads))]
        start = scores.index(min(scores))
        assert got[c] == min(range(start, start + window), key=lambda i: (curve[i], i)), curve


def test_selection_flags(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0.50, 0.20, 0.60, 0.31, 0.30, 0.31])], "grid_idx int, rmse double")
    rows = stability_curve(df.withColumn("c", F.lit(1)), 3, ["c"]).orderBy("grid_idx").collect()
    assert [r["in_window"] for r in rows] == [False] * 3 + [True] * 3
    assert [r["is_lowest"] for r in rows].index(True) == 1
    assert least_error_select(df.withColumn("c", F.lit(1)), ["c"]).first()["grid_idx"] == 1
    none = spark.createDataFrame([(0, "outcome", 0, None)], "fold int, equation string, grid_idx int, rmse double")
    assert failed_curves(none).count() == 1


def test_grid_and_rule_names():
    grid = expand_grid("elastic", {"penalty": [1, 2], "l1_share": [0.1, 0.9]})
    assert [(g.l1_share, g.penalty) for g in grid] == [(0.1, 1), (0.1, 2), (0.9, 1), (0.9, 2)]
    assert rule_named("Goldilocks-Zone") == "stability" and rule_named("rmse") == "least_error"
    with pytest.raises(ValueError):
        rule_named("best")


# ---------------------------------------------------------------- long-run variance


@pytest.mark.parametrize("kernel,width", [("bartlett", 6), ("qs", 6), ("parzen", 6), ("ewc", 9), ("bartlett", 80), ("parzen", 90)])
def test_long_run_matrix(spark, kernel, width):
    x, y, d = arrays(150, 3)
    s = sample(spark, x, y, d, 3)
    got = lrv(s.rows, ["y", "d"], kernel=kernel, bandwidth=width, dof=3, chunk_rows=16).first()
    want = R.long_run(np.column_stack([y, d]), kernel, width, 3)
    np.testing.assert_allclose([got["lrv_0_0"], got["lrv_0_1"], got["lrv_1_1"]], [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-9)


def test_long_run_panel_with_own_bandwidths(spark):
    x, y, d = arrays(150, 3)
    key = np.array(["a"] * 110 + ["b"] * 40)
    s = sample(spark, x, y, d, 3, key=key)
    for limit in (64, 0):  # lag columns, and rolling sums
        got = lrv(s.rows, ["y"], ["k"], bandwidth=rule_bandwidth("lls_nw", F.col("n_obs")), chunk_rows=16,
                  lag_limit=limit).toPandas().set_index("k")
        for name in ("a", "b"):
            m = key == name
            width = int(np.ceil(1.3 * np.sqrt(m.sum())))
            assert got.loc[name, "bandwidth"] == width
            np.testing.assert_allclose(got.loc[name, "lrv_0_0"], R.long_run(y[m], "bartlett", width)[0, 0], rtol=1e-9)


def test_bandwidth_literals(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("b")).first()["b"]
    assert [get(rule_bandwidth("small", horizon=h)) for h in (0, 5, 30)] == [1, 6, 24]
    assert get(rule_bandwidth("newey-west", F.lit(200))) == 4
    assert get(rule_bandwidth("fixed", value=0)) == 1
    with pytest.raises(ValueError):
        rule_bandwidth("fixed")
    with pytest.raises(ValueError):
        rule_bandwidth("pow14")
    with pytest.raises(ValueError):
        rule_bandwidth("other", F.lit(10))
    assert kernel_named("Newey-West") == "bartlett" and kernel_named("quadratic-spectral") == "qs"
    with pytest.raises(ValueError):
        kernel_named("box")


# ---------------------------------------------------------------- stage two


@pytest.mark.parametrize("kernel", ["bartlett", "qs", "parzen", "ewc"])
def test_point_estimate_is_the_same_for_every_kernel(spark, kernel):
    x, y, d = arrays(120, 3)
    resid = sample(spark, x, y, d, 6).residuals().withColumnRenamed("chi0", "chi")
    pdf = frame(resid)
    got = stage2(resid, Inference(kernel=kernel, rule="fixed", value=5), chunk_rows=16).first()
    theta, se, _ = R.stage2_block(pdf["chi"].to_numpy(), pdf["xi"].to_numpy(), 6, 5, kernel)
    np.testing.assert_allclose([got["coef"], got["std_error"]], [theta, se], rtol=1e-9)


def test_fixed_b_widens_and_methods(spark):
    x, y, d = arrays(120, 3)
    resid = sample(spark, x, y, d, 6).residuals().withColumnRenamed("chi0", "chi")
    plain = stage2(resid, Inference(rule="lls_nw")).first()
    wide = stage2(resid, Inference(rule="lls_nw", fixed_b=True)).first()
    assert wide["ci_upper"] - wide["ci_lower"] > plain["ci_upper"] - plain["ci_lower"]
    assert wide["coef"] == plain["coef"]
    andrews = stage2(resid, Inference(rule="andrews")).first()
    assert andrews["bandwidth"] >= 1
    with pytest.raises(ValueError):
        stage2(resid, Inference(method="median"))


def test_flat_policy_gives_an_empty_row(spark):
    rows = [(t, 10, t // 5, float(t), 0.0 if t < 5 else float(t % 3)) for t in range(10)]
    df = spark.createDataFrame(rows, "pos long, n_rows long, block_id int, chi double, xi double")
    got = {r["block_id"]: r for r in block_statistics(df, lag=1).collect()}
    assert got[0]["coefficient"] == 0 and got[0]["std_error"] is None and got[0]["df"] == 0
    assert got[1]["std_error"] is not None


def test_a_step_costs_no_digits(spark):
    x, y, d = arrays(240, seed=5)
    far = x.copy()
    far[120:, 1] += 1e7
    got = frame(sample(spark, far, y, d, 6).residuals())
    np.testing.assert_allclose(got["chi0"], R.cross_residuals(far, y, 6, R.ols), atol=1e-5)


def test_merged_blocks_equal_all_rows():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(90, 3)) + 1e8 * np.array([1.0, 0.0, -1.0])
    z[60:] += 1e7
    parts = []
    for block in (z[:30], z[30:60], z[60:]):
        anchor = block.mean(axis=0)
        one = np.column_stack([np.ones(len(block)), block - anchor])
        parts.append((one.T @ one, anchor))
    g, centre = merged(parts)
    np.testing.assert_allclose(centre, z.mean(axis=0), rtol=1e-15)
    np.testing.assert_allclose(g[1:, 1:], (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rtol=1e-6)


def test_a_fold_without_learner_is_an_error(spark):
    x, y, d = arrays(60)
    s = sample(spark, x, y, d, 3)
    learners = learner_table(spark, 3).where("not (fold = 1 and equation = 'outcome')")
    with pytest.raises(Exception, match="no outcome learner is left for fold 1"):
        s.residuals(learners)


def test_unfinished_descent_is_an_error(monkeypatch):
    import foldwise.operators.learners as learners_module

    monkeypatch.setattr(learners_module, "MAX_SWEEPS", 1)
    rng = np.random.default_rng(9)
    z = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    g = z.T @ z / 50
    with pytest.raises(np.linalg.LinAlgError):
        learners_module.descend(g[:3, :3], g[:3, 3], 1e-6, 0.0, np.zeros(3))


def test_tails_far_out():
    assert t_quantile(0.99999, 1) == pytest.approx(63661.977, rel=1e-6)
    assert float(t_two_sided(1.96, 1e12)) == pytest.approx(0.04999579, rel=1e-6)
    for df in (3, 40, 199.0, 201.0, 4000):
        assert float(t_two_sided(2.0, df)) == pytest.approx(float(beta_tail(df / (df + 4.0), df / 2, 0.5)))
    assert float(log_beta(150.0, 0.5)) == pytest.approx(math.lgamma(150) + math.lgamma(0.5) - math.lgamma(150.5), rel=1e-12)
