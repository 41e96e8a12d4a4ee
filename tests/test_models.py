"""Mixtures, subsets, the forest, synthetic curves, streams and sinks against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.operators import cluster, forest, kernels, mixture, subsets
from lightloom.sources import files
from lightloom.streaming import incremental


def frame(spark, x, **more):
    rows = [(i, [float(v) for v in r], *[int(c[i]) for c in more.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + "".join(f", {n} int" for n in more))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal((0, 0), (1, 0.3), (120, 2)), rng.normal((6, 1), (0.5, 0.5), (80, 2))]) + 1000.0


@pytest.mark.parametrize("shape", mixture.SHAPES)
def test_mixture_is_a_fixed_point(spark, blobs, shape):
    model = mixture.fit(frame(spark, blobs).repartition(3), 2, shape, tol=1e-9)
    assert model.converged and model.n == 200
    r, total = model.responsibilities(blobs)
    assert np.isclose(total.sum(), model.log_likelihood)
    nk = r.sum(0)
    assert np.allclose(np.sort(nk), [80, 120], atol=0.5)
    means = r.T @ blobs / nk[:, None]
    assert np.allclose(means, model.means, atol=1e-3)
    scatter = np.stack([(r[:, j, None] * (blobs - means[j])).T @ (blobs - means[j]) / nk[j] for j in range(2)])
    if shape == "full":
        assert np.allclose(scatter, model.covariances, atol=1e-3)
    elif shape == "diag":
        assert np.allclose([np.diag(np.diag(s)) for s in scatter], model.covariances, atol=1e-3)
    elif shape == "spherical":
        assert np.allclose([np.eye(2) * np.diag(s).mean() for s in scatter], model.covariances, atol=1e-3)
    else:
        assert np.allclose((nk[:, None, None] * scatter).sum(0) / 200, model.covariances[0], atol=1e-3)


@pytest.mark.parametrize("prior", mixture.PRIORS[1:])
def test_variational_mixture_empties_spare_components(spark, blobs, prior):
    model = mixture.fit(frame(spark, blobs), 4, "full", prior, strength=0.01, tol=1e-7, most=150)
    assert np.isclose(model.weights.sum(), 1) and np.sort(model.weights)[-2:].sum() > 0.9
    labels = [r["label"] for r in model.assign(frame(spark, blobs)).orderBy("id").collect()]
    assert labels[0] != labels[-1]


def test_digamma():
    assert np.allclose(mixture.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721])


def test_mixture_refuses(spark, blobs):
    for bad in ({"shape": "round"}, {"prior": "flat"}):
        with pytest.raises(ValueError):
            mixture.fit(frame(spark, blobs), **bad)
    with pytest.raises(ValueError):
        mixture.fit(frame(spark, blobs[:2]), 3)
    with pytest.raises(ValueError):
        mixture.fit(frame(spark, blobs).limit(0), 3)


def test_comparison_and_dispatch(spark, blobs):
    rows, failed = cluster.compare_algorithms(frame(spark, blobs), ("kmeans", "gmm", "none"), n_clusters=2, n_components=2)
    got = {r["algorithm"]: r for r in rows.collect()}
    assert set(got) == {"kmeans", "gmm"} and set(failed) == {"none"} and all(r["n_clusters"] == 2 and r["silhouette"] > 0.5 for r in got.values())


def test_dbscan_holds_long_chains_together(spark):
    ids = np.random.default_rng(11).permutation(600)
    rows = [(int(i), [0.4 * k + 100.0 * (k >= 450), 0.0]) for k, i in enumerate(ids)] + [(1000, [-50.0, 0.0])]
    got = {r["id"]: r["label"] for r in cluster.dbscan(spark.createDataFrame(rows, "id long, vec array<double>"), 0.5, 3).collect()}
    one, two = ({got[int(i)] for i in part} for part in (ids[:450], ids[450:]))
    assert sorted([*one, *two]) == [0, 1] and got[1000] == -1
    chain = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:])], "a long, b long")
    with pytest.raises(RuntimeError):
        cluster.min_label_components(chain, chain.select(F.col("a").alias("id")), most=2)


def test_subsets_of_columns(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, 60)
    rows = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    rows = rows.unionByName(spark.createDataFrame([(99, None, 1.0, 1.0, 1)], rows.schema))
    got = {r["features"]: r for r in subsets.silhouettes(rows, ["a", "b", "c"], F.col("y"), block=16).collect()}
    assert len(got) == 4 and all(r["n"] == 60 for r in got.values())
    for name, r in got.items():
        p = x[:, ["abc".index(c) for c in name.split(",")]]
        dist = np.sqrt(((p[:, None] - p) ** 2).sum(2))
        a = np.array([dist[i, y == y[i]].sum() / ((y == y[i]).sum() - 1) for i in range(60)])
        b = np.array([dist[i, y != y[i]].mean() for i in range(60)])
        assert np.isclose(((b - a) / np.maximum(a, b)).mean(), r["silhouette"])


def test_forest_tells_dependent_from_shuffled(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=300)
    real = frame(spark, np.stack([a, a + 0.05 * rng.normal(size=300)], axis=1)).withColumnRenamed("id", "filename")
    fake = forest.shuffled_columns(real)
    one, two = (np.array([r["vec"] for r in df.orderBy("filename").collect()]) for df in (real, fake))
    assert np.allclose(np.sort(one, axis=0), np.sort(two, axis=0)) and abs(np.corrcoef(two.T)[0, 1]) < 0.3
    model = forest.fit(real, fake, trees=20)
    odd = spark.createDataFrame([(1000, [2.0, -2.0]), (1001, None), (1002, [1.0]), (1003, [float("nan"), 0.0])], "filename long, vec array<double>")
    score = {r["filename"]: r["anomaly_score"] for r in forest.score(real.unionByName(odd), model).collect()}
    assert score[1000] > 0.7 > np.mean([score[i] for i in range(300)]) and score[1001] is score[1002] is score[1003] is None


def test_synthetic_curves_and_flat_box(spark):
    t = np.arange(0, 27, 0.02)
    flux = kernels.limb_darkened(t, 4.0, 1.0, 0.1)
    assert flux.max() == 1.0 and 0.985 < flux.min() < 0.995 and abs(t[flux.argmin()] % 4 - 1.0) < 0.05
    # a dark disc in the middle of a uniform one hides its own area
    assert np.isclose(kernels.limb_darkened(np.array([0.0]), 4.0, 0.0, 0.1, 0.0, 0.0, inclination=90.0)[0], 0.99, atol=1e-6)
    times = spark.range(20).select(F.col("id").alias("key")).join(spark.range(400).select((F.col("id") * 0.05).alias("t")))
    one = kernels.synthetic_curves(times, "key", noise=0.0).orderBy("key", "t").collect()
    two = kernels.synthetic_curves(times.repartition(7), "key", noise=0.0).orderBy("key", "t").collect()
    assert one == two and {r["model"] for r in one} == {"box", "limb_darkened"} and all(0.97 < r["flux"] <= 1.0 for r in one)
    box = spark.createDataFrame([(1, float(x), 0.99 if (x % 4) < 0.25 else float(1.0 + 1e-4 * np.sin(9 * x))) for x in t], "key long, t double, flux double")
    found = kernels.flat_box(box, "key", periods=400, low=3.0, high=5.0, duration=0.25)
    row = found.groupBy("period").agg(F.count("*").alias("n"), F.avg(F.when(F.abs("phase") < 0.02, F.col("z"))).alias("dip"), F.avg(F.when(F.abs("phase") > 0.1, F.col("z"))).alias("flat")).first()
    assert abs(row["period"] - 4) < 0.05 and row["n"] == len(t) and row["dip"] < row["flat"] - 2
    assert not kernels.flat_box(box.withColumn("flux", F.lit(1.0)), "key", periods=5).collect()


def test_streams_take_each_file_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "k string, at timestamp_ntz, v double"
    rows = lambda *r: spark.createDataFrame(list(r), "k string, s string, v double").selectExpr("k", "cast(s as timestamp_ntz) at", "v").coalesce(1)
    rows(("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 02:00:00", 3.0)).write.mode("append").parquet(source)
    step = lambda df: df.withColumn("twice", F.col("v") * 2)
    for _ in range(2):  # the second run finds nothing new
        incremental.drain_by(incremental.new_files(spark, source, schema), step, sink, state)
        assert spark.read.parquet(sink).count() == 2
    rows(("b", "2024-01-02 01:00:00", 5.0)).write.mode("append").parquet(source)
    incremental.drain_by(incremental.new_files(spark, source, schema), step, sink, state)
    assert sorted(r["twice"] for r in spark.read.parquet(sink).collect()) == [2.0, 6.0, 10.0]
    incremental.drain(incremental.new_files(spark, source, schema), f"{sink}-plain", f"{state}-plain")
    assert spark.read.parquet(f"{sink}-plain").count() == 3
    made = incremental.drain_totals(incremental.windowed(incremental.new_files(spark, source, schema), "at", "1 day", ["k"], "v"), f"{sink}-totals", f"{state}-totals")
    assert sorted((r["k"], str(r["start"]), r["n"], r["mean"]) for r in spark.read.parquet(made).collect()) == [("a", "2024-01-01 00:00:00", 2, 2.0), ("b", "2024-01-02 00:00:00", 1, 5.0)]


def test_result_files_and_fetch(spark, tmp_path):
    for name in ("m_n1", "m_n2"):
        (tmp_path / f"{name}_results.csv").write_text("tic,filename,anomaly_score\n7,a.fits,0.5\nNone,b.fits,None\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = files.read_results(spark, str(tmp_path))
    assert sorted((r["variant"], r["tic"]) for r in got.collect() if r["tic"]) == [("m_n1", 7), ("m_n2", 7)] and got.count() == 4
    assert {r["variant"] for r in files.read_results(spark, str(tmp_path), first=1).collect()} == {"m_n1"}
    out = str(tmp_path / "scores")
    for _ in range(2):
        files.write_csv(got.select("tic", "filename"), out, append=True)
    assert files.read_csv(spark, f"{out}/*.csv").count() == 8

    def get(url):
        if url.endswith("2"):
            raise OSError("gone")
        return url.encode()

    urls = spark.createDataFrame([(f"u{i}",) for i in range(5)], "url string")
    rows = {r["url"]: r for r in files.fetch(urls, get, done=urls.filter("url = 'u1'"), start=1).collect()}
    assert set(rows) == {"u2", "u3", "u4"} and rows["u2"]["error"] and bytes(rows["u3"]["content"]) == b"u3"
