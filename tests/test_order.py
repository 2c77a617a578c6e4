"""Positions, overlaps, quantiles, transformations and the sample table."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.functions.transforms import TRANSFORM_CODES, transformed
from foldwise.operators.design import build_design, feature_names, scaled, speeds, transform_all
from foldwise.operators.position import add_position, calendar_gaps, exact_quantiles, ordered_select, reposition
from foldwise.operators.storage import materialize
from foldwise.operators.trend import smooth_trend, trend_ratio
from foldwise.plans.spec import Design
from foldwise.sources.frames import from_dataframe
from foldwise.sources.metadata_csv import meta_dicts, read_metadata_wide


def panel(spark, sizes, seed=0, parts=4):
    rng = np.random.default_rng(seed)
    rows = [(k, t, float(rng.normal(10, 2)), float(rng.normal())) for k, n in sizes.items() for t in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([(str(a), int(float(b)), float(c), float(d)) for a, b, c, d in rows],
                                 "k string, t int, x double, z double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_do_not_depend_on_partitions(spark, parts):
    df = panel(spark, {"a": 700, "b": 3, "c": 1}, parts=parts)
    got = add_position(df, "t", ["k"]).toPandas()
    assert (got["pos"] == got["t"]).all()
    assert (got["n_rows"] == got["k"].map({"a": 700, "b": 3, "c": 1})).all()
    assert len(got) == 704


@pytest.mark.parametrize("chunk", [5, 16, 1000])
def test_overlapping_chunks_equal_one_window(spark, chunk):
    df = add_position(panel(spark, {"a": 103, "b": 4}), "t", ["k"])
    got = ordered_select(df, lambda w: ["k", "pos", F.lag("x", 3).over(w).alias("b3"), F.lead("x", 2).over(w).alias("f2"), "x"],
                         ["k"], before=3, after=2, chunk_rows=chunk).toPandas().sort_values(["k", "pos"])
    for _, part in got.groupby("k"):
        np.testing.assert_array_equal(part["b3"], part["x"].shift(3))
        np.testing.assert_array_equal(part["f2"], part["x"].shift(-2))
    assert len(got) == 107


def test_numbering_after_a_filter(spark):
    df = add_position(panel(spark, {"a": 90, "b": 10}), "t", ["k"])
    got = reposition(materialize(df.where("z > 0")), ["k"], chunk_rows=7).toPandas().sort_values(["k", "old_pos"])
    for _, part in got.groupby("k"):
        assert list(part["pos"]) == list(range(len(part)))
        assert set(part["n_rows"]) == {len(part)}


def test_exact_quantiles(spark):
    df = panel(spark, {"a": 101, "b": 2, "c": 1})
    got = exact_quantiles(df, "x", [0.25, 0.5, 0.75], ["k"]).toPandas().set_index("k")
    raw = df.toPandas()
    for k, part in raw.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["q25", "q50", "q75"]], np.quantile(part["x"], [0.25, 0.5, 0.75]))


def test_quantiles_of_tied_values(spark):
    values = [0.0] * 900 + [1.0] * 90 + [float(v) for v in range(2, 12)]
    df = spark.createDataFrame([(k, v) for k in ("a", "b") for v in values], "k string, x double").repartition(8)
    got = exact_quantiles(df, "x", [0.25, 0.5, 0.9, 0.99, 0.995], ["k"]).toPandas().set_index("k")
    for k in ("a", "b"):
        np.testing.assert_allclose(got.loc[k, ["q25", "q50", "q90", "q99"]], np.quantile(values, [0.25, 0.5, 0.9, 0.99]))
    alone = exact_quantiles(df.where("x < 2"), "x", [0.5]).first()
    assert alone["q50"] == 0.0
    # Ties meet in partial sums: no task sorts more rows than there are different values.
    plan = df.where("k = 'a'").groupBy("k", "x").count()
    assert plan.count() == len(set(values))


def test_missing_keys_and_times_are_errors(spark):
    from pyspark.errors import PySparkException

    for rows in ([("a", 1), (None, 2)], [("a", 1), ("a", None)]):
        df = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "k string, t int, x double")
        with pytest.raises(PySparkException, match="missing values"):
            add_position(df, "t", ["k"])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(t, float("nan") if t == 2 else float(t), 1.0) for t in range(5)], "t int, y double, d double")
    assert [r["y"] for r in from_dataframe(df, "t", "y", "d", []).orderBy("pos").collect()] == [0.0, 1.0, None, 3.0, 4.0]


def test_gaps(spark):
    days = ["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"]
    df = spark.createDataFrame([(d, 1.0) for d in days], "ts string, x double").withColumn("ts", F.to_timestamp("ts"))
    got = calendar_gaps(add_position(df, "ts"), "ts").collect()
    assert [(str(r.gap_from)[:10], str(r.gap_to)[:10], r.step_days) for r in got] == [("2020-01-03", "2020-01-06", 3.0)]
    assert calendar_gaps(add_position(df.limit(2), "ts"), "ts").count() == 0


@pytest.mark.parametrize("code,values,expected", [
    (2, [1, 3, 6], [None, 2, 3]), (7, [100, 110], [None, 10]), (5, [100, 110], [None, 100 * math.log(1.1)]),
    (3, [1, 4, 9], [None, None, 2]), (4, [0, -1, math.e], [None, None, 1]), (7, [0, 5], [None, None]),
    (6, [1, 2, 8], [None, None, math.log(4) - math.log(2)])])
def test_code_literals(spark, code, values, expected):
    df = add_position(spark.createDataFrame(list(enumerate(map(float, values))), "t int, x double"), "t")
    got = transform_all(df, {"x": code}, "t").orderBy("t").toPandas()[f"x_{code}"]
    assert [None if pd.isna(v) else round(v, 9) for v in got] == [None if e is None else round(float(e), 9) for e in expected]


def test_every_code_is_known(spark):
    assert len(TRANSFORM_CODES) == 14
    with pytest.raises(ValueError):
        transformed(F.col("x"), 13, None)


def dense_trend(x, smoothness):
    d = np.diff(np.eye(len(x)), 2, axis=0)
    return np.linalg.solve(np.eye(len(x)) + smoothness * d.T @ d, x)


@pytest.mark.parametrize("n", [4, 5, 6, 40])
def test_trend_system(n):
    x = np.random.default_rng(n).normal(5, 1, n)
    np.testing.assert_allclose(smooth_trend(x, 14400.0), dense_trend(x, 14400.0), rtol=1e-9)


def test_trend_of_many_pieces_at_once():
    x = np.random.default_rng(2).normal(5, 1, (7, 33))
    np.testing.assert_allclose(smooth_trend(x, 1600.0), [dense_trend(row, 1600.0) for row in x], rtol=1e-9)


def test_trend_over_task_batches(spark, monkeypatch):
    monkeypatch.setattr("foldwise.operators.trend.STACK_ROWS", 50)
    x = np.cumsum(np.random.default_rng(4).normal(size=(3, 160)), axis=1) + 100
    rows = [(k, t, float(x[k, t])) for k in range(3) for t in range(160 - 40 * k)]
    df = add_position(spark.createDataFrame(rows, "k int, t int, x double"), "t", ["k"])
    got = trend_ratio(df, "x", "r", ["k"], smoothness=1.0, chunk_rows=64).toPandas().sort_values(["k", "pos"])
    for k in range(3):
        own = x[k, :160 - 40 * k]
        np.testing.assert_allclose(got[got["k"] == k]["r"], own / dense_trend(own, 1.0), rtol=1e-10)


def test_trend_in_chunks_skips_missing_rows(spark):
    x = np.cumsum(np.random.default_rng(3).normal(size=1500)) + 200
    rows = [(t, None if t % 50 == 7 else float(v)) for t, v in enumerate(x)]
    df = add_position(spark.createDataFrame(rows, "t int, x double"), "t")
    got = trend_ratio(df, "x", "r", smoothness=100.0, chunk_rows=128).toPandas().sort_values("pos")
    known = np.array([v for _, v in rows if v is not None])
    np.testing.assert_allclose(got["r"], known / dense_trend(known, 100.0), rtol=1e-10)
    short = add_position(spark.createDataFrame(rows[:3], "t int, x double"), "t")
    assert transform_all(short, {"x": 9}, "t").where("x_9 is not null").count() == 0


def test_design_against_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"t": range(60), "a": np.exp(rng.normal(size=60)), "b": rng.normal(size=60), "c": rng.normal(size=60)})
    pdf.loc[10, "c"] = np.nan
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=2)).withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    spec = Design("t", "a", "b", {"a": 5, "b": 1, "c": 2}, fast=("c",), lags=2, horizons=1, n_blocks=4, scaling="standard")
    got = build_design(df, spec, chunk_rows=9).toPandas().sort_values("pos").reset_index(drop=True)
    tr = pd.DataFrame({"a_5": 100 * np.log(pdf["a"]).diff(), "b_1": pdf["b"], "c_2": pdf["c"].diff()}).dropna()
    want = pd.DataFrame({"cons": 1.0, "c_2": tr["c_2"]})
    for lag in (1, 2):
        for c in tr:
            want[f"lag{lag}_{c}"] = tr[c].shift(lag)
    cols = [c for c in want if c != "cons"]
    want[cols] = (want[cols] - want[cols].mean()) / want[cols].std(ddof=0)
    want["y"], want["d"], want["lead1"] = tr["a_5"], tr["b_1"], tr["a_5"].shift(-1)
    want = want.iloc[2:-1]
    want = want.iloc[:len(want) - len(want) % 4].reset_index(drop=True)
    assert feature_names(spec) == list(want.columns[:-3])
    for c in want:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-12)
    assert list(got["block_id"]) == [i // (len(want) // 4) for i in range(len(want))]


def test_design_errors(spark):
    df = spark.createDataFrame([(t, float(t + 1), 1.0) for t in range(9)], "t int, a double, b double")
    with pytest.raises(KeyError):
        build_design(df, Design("t", "q", "b", {"a": 1, "b": 1}))
    with pytest.raises(ValueError, match="rows are left"):
        build_design(df, Design("t", "a", "b", {"a": 1, "b": 1}, n_blocks=6))
    twice = df.unionByName(df.limit(1))
    with pytest.raises(Exception, match="same time twice"):
        build_design(twice, Design("t", "a", "b", {"a": 1, "b": 1}, n_blocks=2))
    with pytest.raises(ValueError, match="unknown scaling"):
        scaled(df, ["a"], "other")


def test_speeds():
    speed = {"a": "slow", "b": "fast", "c": "slow"}
    assert speeds(speed, to_fast=["c"], remove=["a"]) == ([], ["b", "c"])


def test_input_checks(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "u"), (1, 2.0, 3.0, "u")], "t int, y double, d double, s string")
    with pytest.raises(ValueError, match="unique"):
        from_dataframe(df, "t", "y", "d", [])
    with pytest.raises(TypeError):
        from_dataframe(df, "t", "y", "s", [])
    with pytest.raises(KeyError):
        from_dataframe(df, "t", "y", "q", [])


def test_metadata_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("date,GDP,Rate\nspeed, Slow ,fast\nTransform:,5,2.0\n2005-06-30,107.5,n/a\n30/09/2005,108.1,3.25\n")
    meta, obs = read_metadata_wide(spark, str(path))
    assert meta_dicts(meta) == ({"GDP": "slow", "Rate": "fast"}, {"GDP": 5, "Rate": 2})
    got = [(str(r.ts)[:10], r.GDP, r.Rate) for r in obs.orderBy("ts").collect()]
    assert got == [("2005-06-30", 107.5, None), ("2005-09-30", 108.1, 3.25)]
    many = tmp_path / "many"
    many.mkdir()
    for k in range(3):
        (many / f"{k}.csv").write_text(f"date,U.S. GDP\nspeed,slow\nTransform:,5\n20{10 + k}-06-30,1.5\n")
    meta, obs = read_metadata_wide(spark, str(many))
    assert meta_dicts(meta) == ({"U.S. GDP": "slow"}, {"U.S. GDP": 5}) and obs.where("`U.S. GDP` = 1.5").count() == 3
    (many / "3.csv").write_text("date,U.S. GDP\nspeed,slow\nTransform:,2\n2015-06-30,1\n")
    with pytest.raises(ValueError, match="contradict"):
        read_metadata_wide(spark, str(many))
    bad = tmp_path / "bad.csv"
    bad.write_text("date,GDP\nspeed,slow\n2005-06-30,1\n")
    with pytest.raises(ValueError, match="Transform"):
        read_metadata_wide(spark, str(bad))
