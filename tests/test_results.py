"""Impulse responses, residual checks, distributions, reports."""

import math

import numpy as np
import pytest
import rowwise as R
from pyspark.sql import functions as F
from test_estimation import arrays, sample

from foldwise.functions.dist import (
    critical_value, fixed_b_bartlett, gamma_tail, beta_tail, normal_critical, t_critical, t_quantile, t_two_sided)
from foldwise.functions.text import fixed, stars
from foldwise.operators.crossfit import by_horizon
from foldwise.operators.diagnostics import boundary_leakage, diagnose, joint_f, ljung_box
from foldwise.operators.evaluate import evaluate
from foldwise.operators.projections import cumulate, local_projections, scale_irfs
from foldwise.operators.reports import compare_estimates, irf_report
from foldwise.operators.stage2 import block_statistics, stage2
from foldwise.plans.analyses import static_effect
from foldwise.plans.spec import Inference
from foldwise.sources.frames import write_irf


def test_tails_agree_with_commons_math(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    for df in (1, 2, 7, 58, 400):
        t = dist.TDistribution(float(df))
        for x in (0.1, 1.3, 4.0, 12.0):
            assert abs(float(t_two_sided(x, df)) - 2 * t.cumulativeProbability(-x)) < 1e-10
        assert abs(float(t_quantile(0.95, df)) - t.inverseCumulativeProbability(0.975)) < 1e-6
    for a, b in ((2, 30), (4, 15), (1, 7)):
        f = dist.FDistribution(float(a), float(b))
        for x in (0.2, 1.0, 5.0):
            assert abs(float(beta_tail(b / (b + a * x), b / 2, a / 2)) - (1 - f.cumulativeProbability(x))) < 1e-10
    for k in (1, 2, 8):
        c = dist.ChiSquaredDistribution(float(k))
        for x in (0.3, 2.0, 25.0):
            assert abs(float(gamma_tail(k / 2, x / 2)) - (1 - c.cumulativeProbability(x))) < 1e-10


def test_critical_literals(spark):
    one = spark.range(1)
    get = lambda c: round(one.select(c.alias("v")).first()["v"], 4)
    assert get(critical_value(0.95, F.lit(500))) == 1.96
    assert get(critical_value(0.95, F.lit(60))) == 2.0017
    assert get(fixed_b_bartlett(0.95, F.lit(0.1))) == 2.2606
    assert get(t_critical(0.95, F.lit(10))) == 2.2281
    assert fixed_b_bartlett(0.8, F.lit(0.1)) is None
    assert round(normal_critical(0.9), 4) == 1.6449


def test_stars_and_numbers(spark):
    df = spark.createDataFrame([(0.004,), (0.03,), (0.08,), (0.5,), (None,), (float("nan"),)], "p double")
    got = df.select(stars(F.col("p")).alias("s"), fixed(F.col("p"), 3).alias("f")).collect()
    assert [r["s"] for r in got] == ["***", "**", "*", "", "", ""]
    assert [r["f"] for r in got] == ["0.004", "0.030", "0.080", "0.500", "--", "--"]


def test_cumulate_literals(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0.1), (2.0, 4.0, 0.2)], "chi0 double, chi1 double, xi double")
    second = lambda code: [r["chi1"] for r in cumulate(df, code).collect()]
    assert second(5) == [4, 6] and second(101) == [1, 1.5] and second(None) == [3, 4]
    assert second(12) == [7 / 12, 10 / 12] and second(6) == [3, 4] and second(10) == [4 / 12, 6 / 12]
    keyed = df.withColumn("code", F.when(F.col("chi0") == 1, 5).otherwise(1))
    assert [r["chi1"] for r in cumulate(keyed, "code").collect()] == [4, 4]


def test_first_horizon_equals_static_effect(spark):
    x, y, d = arrays(120, 3)
    s = sample(spark, x, y, d, 6)
    resid = s.residuals()
    irf = local_projections(resid, Inference(), code=5).where("Horizon = 0").first()
    static = static_effect(s, Inference(rule="fixed", value=1)).first()
    assert abs(irf["Coefficient"] - static["coef"]) < 1e-12 and abs(irf["Std_Error"] - static["std_error"]) < 1e-12
    assert by_horizon(resid).count() == 120


IRF = "outcome string, Horizon int, Coefficient double, Std_Error double, p_value double, CI_Lower_95 double, CI_Upper_95 double, CI_Lower_90 double, CI_Upper_90 double"


def irfs(spark, num=4.0, den=-1.0):
    rows = [("num", 0, num, 1.0, 0.001, 2.0, 6.0, 3.0, 5.0), ("den", 0, den, 0.5, 0.2, -2.0, 0.0, -1.5, -0.5),
            ("spread", 0, 0.2, 0.1, 0.03, 0.0, 0.4, 0.1, 0.3), ("spread", 1, -0.1, 0.1, 0.5, -0.3, 0.1, -0.2, 0.0)]
    return spark.createDataFrame(rows, IRF)


def test_scaling_literals(spark):
    got = {(r["outcome"], r["Horizon"]): r for r in scale_irfs(irfs(spark), "num", "den", ["spread"], 0.5).collect()}
    assert abs(got["num", 0]["Coefficient"] - got["den", 0]["Coefficient"] - 0.5) < 1e-12
    assert abs(got["spread", 0]["Coefficient"] - 0.2 * 0.1 * 100) < 1e-12
    turned = scale_irfs(irfs(spark, -4.0, 1.0), "num", "den", [], 0.5).where("outcome = 'num'").first()
    assert turned["CI_Lower_95"] <= turned["CI_Upper_95"] and turned["Std_Error"] > 0
    with pytest.raises(KeyError):
        scale_irfs(irfs(spark), "other", "den")
    with pytest.raises(ValueError):
        scale_irfs(irfs(spark, 1.0, 1.0), "num", "den")


def test_irf_report_layout(spark):
    irf = irfs(spark).where("outcome = 'spread'")
    rows = irf_report(irf).orderBy("horizon", "line").collect()
    assert [r["Estimate"] for r in rows] == ["0.200**", "(0.100)", "-0.100", "(0.100)"]
    assert rows[0]["95% CI"] == "[0.000, 0.400]" and rows[1]["h"] == ""
    assert "95% CI" not in irf_report(irf, show_ci=False).columns
    with pytest.raises(KeyError):
        irf_report(irf.drop("Horizon"))


def test_comparison_layout(spark):
    df = spark.createDataFrame([("A", 1.02, 0.11, 9.3, 0.0, 0.8, 1.24, 6, "rcf"), ("B", 0.9, 0.2, 4.5, 0.2, 0.5, 1.3, 12, "nlo")],
                               "label string, coef double, std_error double, t_stat double, p_value double, ci_lower double, "
                               "ci_upper double, n_blocks int, design string")
    got = {r["statistic"]: r for r in compare_estimates(df, ["A", "B"]).collect()}
    assert got["theta"]["A"] == "1.0200***" and got["Sample use"]["A"] == "0.667" and got["Sample use"]["B"] == "0.764"
    assert len(got) == 7 and len(compare_estimates(df, ["A"], include_ci=False, include_blocks=False).collect()) == 4


def test_write_and_read_back(spark, tmp_path):
    write_irf(irfs(spark), str(tmp_path / "csv"), ["outcome"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True)
    assert back.count() == 4 and "outcome" in back.columns


def test_evaluation_row(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5, 1.5), ("a", 2.0, 1.6, 2.4)], "design string, coef double, ci_lower double, ci_upper double")
    got = evaluate(df, 1.25).first()
    assert (got["bias_pct"], got["coverage_pct"]) == (20.0, 50.0) and abs(got["rmse"] - math.sqrt((0.0625 + 0.5625) / 2)) < 1e-12


# ---------------------------------------------------------------- residual checks


def residual_frame(spark, r, k):
    size = len(r) // k
    rows = [(t, len(r), t // size if t // size < k else None, float(v)) for t, v in enumerate(r)]
    return spark.createDataFrame(rows, "pos long, n_rows long, block_id int, r double").repartition(3)


def test_ljung_box_equals_direct_sum(spark):
    r = np.random.default_rng(2).normal(size=300)
    got = ljung_box(residual_frame(spark, r, 5), "r", 4, chunk_rows=32).orderBy("lag").toPandas()
    c, n = r - r.mean(), 300
    total = 0.0
    for k in range(1, 5):
        total += (c[k:] @ c[:-k] / (c @ c)) ** 2 / (n - k)
        assert abs(got["lb_stat"][k - 1] - n * (n + 2) * total) < 1e-9


def edge_times(n, k, m):
    size = n // k
    return [t for t in range(m, n - m) if any((t + s) // size != t // size for s in range(-m, m + 1))]


def test_leakage_equals_row_route(spark):
    r = np.random.default_rng(7).normal(size=240)
    got = {x["fold"]: x for x in boundary_leakage(residual_frame(spark, r, 6), "r", 6, 2).collect()}
    times = np.array(edge_times(240, 6, 2))
    z = np.column_stack([r[times + s] for s in (-2, -1, 1, 2)])
    x1 = np.column_stack([np.ones(len(times)), z])
    e1 = r[times] - x1 @ np.linalg.lstsq(x1, r[times], rcond=None)[0]
    e0 = r[times] - r[times].mean()
    f = ((e0 @ e0 - e1 @ e1) / 4) / (e1 @ e1 / (len(times) - 5))
    assert got["pooled"]["n_obs"] == len(times) and abs(got["pooled"]["F_stat"] - f) < 1e-9
    assert all(got[str(b)]["F_stat"] is None for b in range(6))


def test_leakage_has_power_and_size(spark):
    rng = np.random.default_rng(0)
    white = rng.standard_normal(240)
    slow = np.zeros(240)
    for t in range(1, 240):
        slow[t] = 0.9 * slow[t - 1] + rng.standard_normal()
    p = lambda r: boundary_leakage(residual_frame(spark, r, 6), "r", 6).where("fold = 'pooled'").first()["p_value"]
    assert p(white) > 0.05 and p(slow) < 0.01
    with pytest.raises(ValueError):
        boundary_leakage(residual_frame(spark, white, 6), "r", 6, 0)


def test_controls_stay_outside_the_test():
    rng = np.random.default_rng(3)
    z, c = rng.normal(size=(60, 2)), rng.normal(size=(60, 1))
    y = 3 * c[:, 0] + rng.normal(size=60)
    f, p, n, q = joint_f(y, z, c)
    assert p > 0.01 and (n, q) == (60, 2)


def test_diagnose_both_equations(spark):
    x, y, d = arrays(120, 3)
    got = diagnose(sample(spark, x, y, d, 6).residuals(), 6, lags=3)
    assert {r["equation"] for r in got["leakage"].collect()} == {"policy", "outcome"}
    assert got["ljung_box"].count() == 6
    assert R.blocks(10, 3)[9] == -1


def test_block_statistics_by_horizon(spark):
    x, y, d = arrays(120, 3)
    tall = by_horizon(sample(spark, x, y, d, 6).residuals())
    got = block_statistics(tall, by=["h"], lag=F.col("h") + 1).toPandas()
    one = block_statistics(tall.drop("h"), lag=1).toPandas()
    assert len(got) == 6 and np.allclose(got.sort_values("block_id")["std_error"], one.sort_values("block_id")["std_error"])


def test_cosine_critical_value(spark):
    x, y, d = arrays(120, 3)
    resid = sample(spark, x, y, d, 6).residuals().withColumnRenamed("chi0", "chi")
    got = stage2(resid, Inference(kernel="ewc", rule="fixed", value=10, fixed_b=True)).first()
    assert abs((got["ci_upper"] - got["coef"]) / got["std_error"] - 2.2281389) < 1e-5
