"""Fast periodograms against the closed form, whichever tasks the points are in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.operators import match, series, spectra


@pytest.mark.parametrize("n", [2, 3, 17, 500, 1024])
def test_sums(n):
    rng = np.random.default_rng(n)
    t, w = rng.uniform(0, 40, 300), rng.normal(size=300)
    f = 0.07 + np.arange(n) * 0.013
    want = (w * np.exp(-2j * np.pi * f[:, None] * t)).sum(1)
    assert np.abs(spectra.sums(spectra.spread(t, w, 0.07, 0.013, n), n) - want).max() < 1e-8
    parts = sum(spectra.spread(t[i::3], w[i::3], 0.07, 0.013, n) for i in range(3))
    assert np.abs(spectra.sums(parts, n) - want).max() < 1e-8


@pytest.mark.parametrize("long", [1 << 20, 100])
def test_power(spark, long):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, n in enumerate((40, 900, 2500)):
        t = np.sort(rng.uniform(100, 112, n))
        y = 50 + np.sin(2 * np.pi * t / (1.1 + k)) + 0.2 * rng.normal(size=n)
        rows += [(f"s{k}", float(a), float(b)) for a, b in zip(t, y)]
        want[f"s{k}"] = t, y
    rows += [("flat", float(i), 2.0) for i in range(30)] + [("once", 1.0, 1.0), ("s1", None, 1.0), ("s1", 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "key string, t double, flux double").repartition(5)
    grid = spectra.grids(df, "key", 0.5, 20.0, 10)
    got = spectra.power(df, "key", grid, long).toPandas()
    assert set(got.key) == {"s0", "s1", "s2", "flat"} and got[got.key == "flat"].power.isna().all()
    plain = series.regular_grid(df, "key", 0.5, 20.0, 10).toPandas()
    for k, (t, y) in want.items():
        own = got[got.key == k].sort_values("i")
        f = plain[plain.key == k].sort_values("i").f.to_numpy()
        assert np.allclose(own.f, f) and np.allclose(own.power.to_numpy(dtype=float), match.gls(t, y, f), atol=1e-8)


def test_a_long_series(spark):
    n = 2_000_000
    rows = spark.range(n).select(F.lit("a").alias("key"), (F.col("id") * (30.0 / n) + F.rand(1) * 1e-5).alias("t"))
    rows = rows.withColumn("flux", F.sin(2 * np.pi * F.col("t") / 3.7) + F.randn(2))
    best = series.best_period(spectra.power(rows, "key", spectra.grids(rows, "key", 0.2, 20.0, 10)), "key").first()
    assert abs(best.best_period - 3.7) < 0.05 and 0.3 < best.peak_power < 0.36
