"""Places and quantiles, pairs in blocks, reports, and further readers and writers against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lightloom.functions import exprs as X
from lightloom.operators import cluster, match, ranks, relational, series
from lightloom.sources import files


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(5)
    n = 400
    return pd.DataFrame({"variant": rng.choice(["a", "b", None], n, p=[0.6, 0.3, 0.1]), "filename": [f"f{i:03d}" for i in range(n)], "score": np.where(rng.random(n) < 0.4, 0.0, rng.integers(-5, 30, n) / 7)})


def test_numbered(spark, scored):
    df = spark.createDataFrame(scored).repartition(7)
    for by in ([], ["variant"]):
        got = ranks.numbered(df, [F.col("score").desc(), F.col("filename")], by).toPandas()
        for _, part in got.groupby("variant", dropna=False) if by else [(None, got)]:
            want = part.sort_values(["score", "filename"], ascending=[False, True])
            assert want.rn.tolist() == list(range(1, len(part) + 1)) and (part.n == len(part)).all()
    assert not ranks.numbered(df.limit(0), [F.col("filename")]).collect()


def test_quantiles(spark, scored):
    at = [0.0, 0.17, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(scored).unionByName(spark.createDataFrame([("a", "x", None), ("empty", "y", None)], "variant string, filename string, score double"))
    for by in ([], ["variant"]):
        got = ranks.quantiles(df, "score", at, by).toPandas()
        for v, part in got.groupby("variant", dropna=False) if by else [(None, got)]:
            rows = scored if not by else scored[scored.variant.isna()] if pd.isna(v) else scored[scored.variant == v]
            assert np.allclose(part.sort_values("i").threshold, np.quantile(rows.score, at)) and sorted(part.i) == list(range(5))
    assert not ranks.quantiles(df.limit(0), "score", at).collect()


def test_reports(spark, scored):
    rows = scored[scored.variant.notna()].assign(is_flagged=lambda d: (d.filename.str[-1] == "3").astype(int), importance=lambda d: d.filename.str[1:].astype(float))
    df = spark.createDataFrame(rows)
    got = {r["variant"]: r["mean_recall"] for r in relational.recall_report(df, 20).collect()}
    report, chosen = relational.auc_report(df)
    report = {r["variant"]: r for r in report.collect()}
    for v, part in rows.groupby("variant"):
        cuts, flagged = np.quantile(part.score, np.arange(21) / 20), part[part.is_flagged == 1]
        assert np.isclose(got[v], np.mean([(flagged.score >= c).sum() / len(flagged) for c in cuts]))
        best = part.sort_values(["score", "filename"], ascending=[False, True]).reset_index(drop=True)
        y = [best.head(int(len(best) * p / 100)).is_flagged.sum() / len(flagged) for p in range(5, 101, 5)]
        assert np.isclose(report[v]["auc_recall"], np.trapezoid(y, np.arange(5, 101, 5) / 100))
        above = best[best.score > 0]
        places = above.assign(p=above.index / len(above) * 100)
        top = places[places.is_flagged == 1].sort_values("importance", ascending=False)
        top = top.head(max(1, int(len(top) * 0.2)))
        assert np.allclose([report[v]["top20_lower"], report[v]["top20_upper"]], [top.p.min(), top.p.max()])
        assert {r["filename"] for r in chosen.filter((F.col("variant") == v) & (F.col("percent") == 20)).collect()} == set(top.filename)
    with pytest.raises(Exception, match="no flagged rows"):
        relational.recall_report(df.withColumn("is_flagged", F.lit(0)), 5).collect()
    assert not relational.auc_report(df.withColumn("is_flagged", F.lit(0)))[0].collect()


def test_blocks(spark):
    rng = np.random.default_rng(6)
    x, y = np.round(rng.normal(size=(60, 4))), np.round(rng.normal(size=(50, 4)))
    left = spark.createDataFrame([(f"o{i:02d}", r.tolist()) for i, r in enumerate(x)] + [("null", None)], "filename string, vec array<double>")
    right = spark.createDataFrame([(f"l{i:02d}", r.tolist(), "t") for i, r in enumerate(y)], "filename string, vec array<double>, label string")
    got = {r["filename"]: r for r in match.cosine_top1(left, right, digits=9, block=16).collect()}
    sims = np.round(match.cosines(x, y), 9)
    assert len(got) == 61 and got["null"]["similarity"] == 0 and got["null"]["matched"] == "l00"
    for i in range(60):
        assert got[f"o{i:02d}"]["matched"] == f"l{sims[i].argmax():02d}" and got[f"o{i:02d}"]["similarity"] == sims[i].max()
    near = match.cosine_top1(left, right, similarity=lambda a, b: -((a[:, None] - b) ** 2).sum(2), block=16)
    assert {r["filename"]: r["matched"] for r in near.collect()}["o07"] == f"l{((x[7] - y) ** 2).sum(1).argmin():02d}"
    pairs = {(r["a"], r["b"]) for r in cluster.neighbours(left.filter("vec is not null"), 1.5, "filename").collect()}
    assert pairs == {(f"o{i:02d}", f"o{j:02d}") for i in range(60) for j in range(60) if np.linalg.norm(x[i] - x[j]) <= 1.5}


def test_median_normalise_and_grids(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(t), float(v)) for k in ("a", "b") for t, v in zip(rng.uniform(0, 20, 700), rng.normal(5, 1, 700))]
    df = spark.createDataFrame(rows + [("a", None, 1.0), ("z", 1.0, 0.0)], "key string, t double, flux double")
    got = series.median_normalise(df, "key").toPandas()
    assert np.allclose(got.groupby("key").flux.median()[["a", "b"]], 1) and got[got.key == "z"].flux.isna().all()
    grid = spark.createDataFrame([(i, 0.1 + i / 50) for i in range(90)], "i int, f double")
    power = series.periodogram(df.repartition(5), "key", grid).toPandas()
    for k in ("a", "b"):
        t, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        assert np.allclose(power[power.key == k].sort_values("i").power, match.gls(t, y, 0.1 + np.arange(90) / 50), atol=1e-9)


def test_folders(spark, tmp_path):
    for sub in ("one", "two"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / f"{sub}.csv").write_text("tic,filename,anomaly_score\n1,x,0.5\n")
    got = files.with_folder(files.read_scores(spark, str(tmp_path / "*")))
    assert sorted((r["input_dir"], r["filename"]) for r in got.collect()) == [("one", "x"), ("two", "x")]
    assert files.pick_random(spark, str(tmp_path), "*.csv").endswith(".csv") and files.pick_random(spark, str(tmp_path), "*.fits") is None
    for name, v in (("p_SIM_time", [0, 1, 2]), ("p_SIM_0_box", [1, 2, 3]), ("p_SIM_1_box", [4, 5, 6])):
        np.save(tmp_path / f"{name}.npy", np.array(v, dtype=float))
    points = files.read_array_folder(spark, str(tmp_path), "p_SIM_time.npy").orderBy("filename", "t").collect()
    assert [(r["t"], r["flux"]) for r in points] == [(0, 1), (1, 2), (2, 3), (0, 4), (1, 5), (2, 6)]
    with pytest.raises(FileNotFoundError):
        files.read_array_folder(spark, str(tmp_path), "no.npy")
    labels = spark.createDataFrame([("a", 0), ("b", -1), ("c", 0)], "filename string, label int")
    files.write_cluster_report(labels, str(tmp_path / "out"), "dbscan", {"Silhouette Score": 0.12345, "Inertia": float("nan")}, "r1")
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/dbscan_metadata_r1").collect())
    assert text.splitlines() == ["Clustering Algorithm: dbscan", "Silhouette Score: 0.123", "Cluster Sizes:", "  Noise (label -1): 1 curves", "  Cluster 0: 2 curves"]
    assert files.read_csv(spark, f"{tmp_path}/out/dbscan_results_r1").count() == 3


def test_small_helpers(spark):
    df = spark.createDataFrame([("Yes",), (" off ",), (None,)], "v string")
    assert [r[0] for r in df.select(X.truth("v")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="truth value"):
        spark.createDataFrame([("maybe",)], "v string").select(X.truth("v")).collect()
    with pytest.raises(ValueError, match="missing columns: a, b"):
        relational.require(df, "a", "v", "b")
    counts = relational.value_counts(spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "v string"), "v").collect()
    assert [(r["v"], r["n"]) for r in counts] == [("y", 2), ("x", 1)]
