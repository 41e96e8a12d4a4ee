"""Downloads into a store, array sinks, kept models, repeated test sets and gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.operators import cluster, forest, kernels, relational, series
from lightloom.sources import files


def test_downloads(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def get(url, timeout):
        assert timeout == 5
        name = url.rsplit("/", 1)[-1].split("?")[0]
        with open(marks / name, "a") as f:
            f.write("x")
        yield b"first "
        if name == "broken" or (name == "late" and (marks / name).read_text() == "x"):
            raise OSError("gone")
        yield name.encode()

    store = tmp_path / "store"
    store.mkdir()
    (store / "has").write_text("old")
    names = ["a", "broken", "has", "late", "z?token=1"]
    urls = spark.createDataFrame([(f"http://x/{n}",) for n in names] + [("http://y/a",), ("http://x/",), (None,)], "url string")
    got = {r["filename"]: r for r in files.download(urls, str(store), get, tasks=2, timeout=5, tries=2, wait=0.01).collect()}
    assert {n: r["status"] for n, r in got.items()} == {"a": "done", "broken": "failed", "has": "there", "late": "done", "z": "done"}
    assert got["a"]["url"] == "http://x/a" and got["a"]["bytes"] == 7 and got["broken"]["error"] == "OSError: gone" and got["has"]["bytes"] is None
    assert sorted(p.name for p in store.iterdir() if not p.name.endswith(".crc")) == ["a", "has", "late", "z"]  # nothing that broke off is left
    assert (store / "late").read_text() == "first late" and (marks / "broken").read_text() == "xx" and (store / "has").read_text() == "old"
    again = files.download(urls, f"file://{store}", get, start=1, most=2, tasks=1, timeout=5, tries=1).collect()
    assert {r["filename"]: r["status"] for r in again} == {"broken": "failed", "has": "there"}
    assert files.download(urls.limit(0), str(store), get).isEmpty()


def test_array_parts(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(250, 4))
    df = spark.createDataFrame([(f"f {i}", [float(v) for v in row], 1) for i, row in enumerate(x)], "filename string, vec array<double>, stem int").repartition(3)
    told = files.write_array_parts(df, str(tmp_path / "out"), rows=40)
    assert told.agg(F.sum("rows"), F.max("rows")).first() == (250, 40) and told.count() >= 7
    got = {r["filename"]: r["vec"] for r in files.read_array_parts(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 250 and all(np.array_equal(got[f"f {i}"], x[i]) for i in range(250))
    assert files.write_array_parts(df.limit(0), str(tmp_path / "none")).isEmpty()
    for bad in ([("a", [1.0]), ("b", [1.0, 2.0])], [("a\nb", [1.0])], [(None, [1.0])]):
        with pytest.raises(Exception, match="several"):
            files.write_array_parts(spark.createDataFrame(bad, "filename string, vec array<double>").coalesce(1), str(tmp_path / "bad"))


def test_kept_models_score_repeated_sets(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(300, 1)), 3, axis=1) + 0.05 * rng.normal(size=(300, 3))
    odd = np.arange(300) % 10 == 0
    x[odd] = rng.normal(size=(30, 3)) * 2
    rows = spark.createDataFrame([(f"f{i:03d}", [float(v) for v in r], bool(o)) for i, (r, o) in enumerate(zip(x, odd))], "filename string, vec array<double>, flag boolean")
    model = forest.fit(rows, forest.shuffled_columns(rows), trees=20, depth=6)
    forest.save(model, str(tmp_path / "forest"))
    forest.save(model, str(tmp_path / "forest"))
    kept = forest.load(str(tmp_path / "forest"))
    a, b = (forest.score(rows, m).toPandas().sort_values("filename") for m in (model, kept))
    assert np.array_equal(a.anomaly_score, b.anomaly_score)
    sets = relational.stratified_sample(rows, "flag", "filename", 50, sets=3)
    got = forest.score_sets(sets, kept, "flag").toPandas()
    score = dict(zip(a.filename, a.anomaly_score))
    members = sets.select("set_id", "filename", "flag").toPandas()
    assert sorted(got.set_id) == [0, 1, 2] and (got.n == 50).all() and (got.positives == 5).all() and (got.scored == 50).all()
    for r in got.itertuples():
        own = members[members.set_id == r.set_id]
        assert np.isclose(r.mean_positive, np.mean([score[f] for f in own.filename[own.flag]])) and r.mean_positive > r.mean_other
    assert len({frozenset(g.filename) for _, g in members.groupby("set_id")}) == 3
    plane = cluster.fit_projection(rows, 2)
    plane.save(spark, str(tmp_path / "plane"))
    again = cluster.Projection.load(spark, str(tmp_path / "plane"))
    assert np.array_equal(plane.axes, again.axes) and np.array_equal(plane.mean, again.mean) and again.ratio == [float(r) for r in plane.ratio]


def test_gates_of_periods(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key, period in (("short", 0.7), ("middle", 2.3), ("long", 6.1)):
        t = np.sort(rng.uniform(0, 40, 300))
        rows += [(key, float(a), float(np.sin(2 * np.pi * a / period) + 0.05 * rng.normal())) for a in t]
    df = spark.createDataFrame(rows, "key string, t double, flux double")
    keys = lambda **gate: {r["key"] for r in series.phase_fold(df, "key", **gate)[0].select("key").distinct().collect()}
    assert keys() == {"short", "middle", "long"}
    assert keys(least_period=1.0, most_period=4.0) == {"middle"} and keys(least_period=1.0) == {"middle", "long"} and keys(most_period=1.0) == {"short"}


def test_rejects_are_counted(spark):
    good = [1.0] * 10
    rows = [(good, True), ([float("nan"), *good[1:]], False), ([None, *good[1:8], float("inf"), 1.0], False), (None, None)]
    got = kernels.reject_report(spark.createDataFrame(rows, "features array<double>, is_valid boolean")).first()
    assert (got["rows"], got["valid"], got["rejected"]) == (4, 1, 3)
    assert got["lacking"]["transit_depth"] == 3 and got["lacking"]["bls_snr"] == 2 and got["lacking"]["sharpness"] == 1
