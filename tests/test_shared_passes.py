"""All horizons side by side, and sweeps with shared products, beside one estimate at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators.crossfit import by_horizon
from foldwise.operators.evaluate import sweep
from foldwise.operators.stage2 import stage2, stage2_horizons
from foldwise.plans.spec import Inference


def residuals(spark, holes=False, k=4, leads=3, sizes=(("a", 60), ("b", 203))):
    r, rows = np.random.default_rng(7), []
    for name, n in sizes:
        xi = r.normal(size=n)
        chi = 0.5 * xi[:, None] + np.cumsum(r.normal(size=(n, leads)), axis=0) * 0.3 + 1e4
        for t in range(n // k * k):
            y = [None if holes and t == 17 else float(v) for v in chi[t]]
            rows.append((name, t, t, n, t // (n // k), float(xi[t]), *y))
    frame = spark.createDataFrame(rows, "series string, ts long, pos long, n_rows long, block_id int, xi double, " + ", ".join(f"chi{h} double" for h in range(leads)))
    return frame.repartition(5)


def same(got, want, by):
    names = ["coef", "std_error", "t_stat", "p_value", "ci_lower", "ci_upper", "n_obs", "n_blocks", "bandwidth"]
    got, want = (x.orderBy(*by).select(*by, *names).collect() for x in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [a[c] for c in by] == [b[c] for c in by]
        np.testing.assert_allclose([a[c] for c in names], [b[c] for c in names], rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("spec", [Inference(), Inference(kernel="qs", rule="fixed", value=5, intercept=False), Inference(kernel="parzen", rule="pow14", fixed_b=True),
                                  Inference(lag=0), Inference(fixed_b=True)])
def test_horizons_side_by_side_equal_one_by_one(spark, spec):
    resid = residuals(spark)
    got = stage2_horizons(resid, spec, ["series"], 16)
    same(got, stage2(by_horizon(resid, ["series"]), spec, ["series", "h"], 16), ["series", "h"])
    alone = resid.where("series = 'b'").drop("series")
    same(stage2_horizons(alone, spec, (), 50), stage2(by_horizon(alone), spec, ["h"], 50), ["h"])


def test_tables_with_holes_or_other_estimators_go_one_by_one(spark):
    assert stage2_horizons(residuals(spark, holes=True), Inference(), ["series"]) is None
    flat = residuals(spark).withColumn("xi", F.when(F.col("block_id") == 1, 1.0).otherwise(F.col("xi")))
    assert stage2_horizons(flat, Inference(), ["series"]) is None
    for spec in (Inference(kernel="ewc"), Inference(rule="andrews"), Inference(rule="fixed", value=150), Inference(method="full")):
        assert stage2_horizons(residuals(spark), spec, ["series"]) is None


def test_sweep_equals_single_specifications(spark):
    resid = residuals(spark, holes=True).withColumn("chi", F.col("chi1"))
    specs = {"plain": Inference(), "qs": Inference(kernel="qs"), "parzen5": Inference(kernel="parzen", rule="fixed", value=5), "ewc": Inference(kernel="ewc", fixed_b=True, rule="lls_ewc"),
             "andrews": Inference(rule="andrews"), "long": Inference(rule="fixed", value=70), "through_origin": Inference(intercept=False), "average": Inference(se="fold_average"),
             "full": Inference(method="full")}
    for rows, by in ((resid, ["series"]), (resid.where("series = 'b'").drop("series"), [])):
        got = sweep(rows, specs, by, 32).collect()
        for name, spec in specs.items():
            want = {tuple(r[k] for k in by): r for r in stage2(rows, spec, by, 32).collect()}
            mine = [r for r in got if r["spec"] == name]
            assert len(mine) == len(want) and all(r["kernel"] == spec.kernel and r["rule"] == spec.rule for r in mine)
            for r in mine:
                other = want[tuple(r[k] for k in by)]
                for c in ("coef", "std_error", "ci_lower", "ci_upper"):
                    assert abs(r[c] - other[c]) < 1e-9 * max(1, abs(other[c])), (name, c)
                assert r["n_obs"] == other["n_obs"]
    with pytest.raises(ValueError, match="standard errors"):
        sweep(resid, {"x": Inference(se="other")}, ["series"])
