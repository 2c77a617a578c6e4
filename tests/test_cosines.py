"""Many cosines by moments and one transform, beside rows times cosines."""

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from foldwise.operators.hac import _chirp, lrv


def plain(z, terms):
    n = len(z)
    z = z - z.mean(axis=0)
    basis = np.cos(np.pi * np.outer(np.arange(1, terms + 1), np.arange(n) + 0.5) / n)
    lam = np.sqrt(2 / n) * basis @ z
    return lam.T @ lam / terms


def test_chirp_is_the_plain_sum():
    r = np.random.default_rng(3)
    for n, q, terms in ((1000, 3, 40), (977, 1, 976), (10 ** 9 + 7, 1591, 300), (10 ** 11 + 3, 7001, 50)):
        x = r.normal(size=min((n - 1) // q + 1, 500))
        want = [np.sum(x * np.exp(1j * np.pi * np.array([j * q * b % (2 * n) for b in range(len(x))]) / n)) for j in range(1, terms + 1)]
        np.testing.assert_allclose(_chirp(x, q, n, terms), want, atol=1e-9)


@pytest.mark.parametrize("few", [0, 5, 1000])
def test_cosine_sums_agree_for_all_numbers_of_terms(spark, monkeypatch, few):
    monkeypatch.setattr("foldwise.operators.hac.FEW_COSINES", few)
    r = np.random.default_rng(5)
    series = {"a": (401, 3), "b": (97, 60), "c": (50, 49), "d": (1200, 12), "e": (2, 1)}
    rows, data = [], {}
    for name, (n, _) in series.items():
        data[name] = np.cumsum(r.normal(size=(n, 2)), axis=0) + 1e5
        rows += [(name, t, n, float(x), float(y)) for t, (x, y) in enumerate(data[name])]
    frame = spark.createDataFrame(rows, "series string, pos long, n_rows long, x double, y double").repartition(6)
    width = F.coalesce(*[F.when(F.col("series") == k, v) for k, (_, v) in series.items()])
    for got in lrv(frame, ["x", "y"], ["series"], "ewc", width, chunk_rows=64).collect():
        want = plain(data[got["series"]], series[got["series"]][1])
        scale = want.max()
        np.testing.assert_allclose([got["lrv_0_0"], got["lrv_0_1"], got["lrv_1_1"]], [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-9, atol=1e-9 * scale)
    alone = lrv(frame.where("series = 'd'").drop("series"), ["x"], kernel="ewc", bandwidth=300, chunk_rows=64).first()
    assert abs(alone["lrv_0_0"] - plain(data["d"][:, :1], 300)[0, 0]) < 1e-8 * alone["lrv_0_0"]


def test_no_task_of_many_cosines_reads_a_whole_series(spark, monkeypatch):
    """The transform of a long series is dealt to tasks whose groups grow as the root of its rows."""
    monkeypatch.setattr("foldwise.operators.hac.ONE_STEP", 64, raising=False)
    n, most = 6000, 4 * 6000 ** 0.5
    z = np.cumsum(np.random.default_rng(8).normal(size=n)) + 1e5
    frame = spark.createDataFrame([(t, n, float(x)) for t, x in enumerate(z)], "pos long, n_rows long, x double").repartition(5)
    plain_apply = GroupedData.applyInPandas

    def counted(self, func, schema):
        def run(pdf):
            if len(pdf) > most:
                raise ValueError(f"a group of {len(pdf)} rows")
            return func(pdf)

        return plain_apply(self, run, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    got = lrv(frame, ["x"], kernel="ewc", bandwidth=1500, chunk_rows=512).first()["lrv_0_0"]
    assert abs(got - plain(z[:, None], 1500)[0, 0]) < 1e-9 * got
