"""Registered queries against DuckDB, kernels against plain numpy, and the FITS reader."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from lightloom.operators import kernels, match
from lightloom.plans import catalogue
from lightloom.sources import files

SF = "/root/testdata/sf0.001"


def plain(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
    return df.sort_values(cols).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", ["wrss_fusion", "sql_front_like", "phase_fold_bins", "periodogram_peak", "shape_features", "dbscan_labels", "topk_recall_curve", "cosine_match_threshold", "variant_report", "auc_report", "recall_report", "sharpness", "dtw_pairs", "scale_robust", "silhouette", "davies_bouldin", "existing_marked", "label_counts"])
def test_query(spark, duck, name):
    pd.testing.assert_frame_equal(plain(catalogue.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(catalogue.ORACLES[name]).df()), check_dtype=False)


def test_kernels():
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 27, 300))
    f = np.linspace(0.05, 1, 400)
    power = match.gls(t, np.sin(2 * np.pi * t / 3.7), f)
    assert abs(1 / f[np.nanargmax(power)] - 3.7) < 0.05 and np.nanmax(power) > 0.95
    y = np.where((t % 4) < 0.25, 0.99, 1.0)
    assert abs(kernels.bls(t, y, np.linspace(3, 5, 400), 0.2)[0] - 4) < 0.1
    a, b = np.array([[0.0, 1, 2]]), np.array([[0.0, 0, 1, 2]])
    assert kernels.dtw(a, b) == 0 == kernels.dtw(b, a) and kernels.dtw(a, a + 1) > 0
    a, b = rng.normal(size=(3, 7)), rng.normal(size=(3, 5))
    for k in range(3):
        table = np.full((8, 6), np.inf)
        table[0, 0] = 0
        for i in range(7):
            for j in range(5):
                table[i + 1, j + 1] = (a[k, i] - b[k, j]) ** 2 + min(table[i, j], table[i, j + 1], table[i + 1, j])
        assert np.isclose(kernels.dtw(a, b)[k], np.sqrt(table[7, 5]))
    assert kernels.find_peaks(np.array([0, 1, 0, 2, 2, 0.0]), 0.5) == [1, 3]


def test_box_search_takes_every_step(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 3
    for k in range(n):
        t = np.sort(rng.uniform(0, 60, 200))
        rows += [(k, float(x), float(v)) for x, v in zip(t, np.where((t % (1.3 + k)) < 0.1, 0.9, 1.0) + 0.01 * rng.normal(size=200))]
    rows += [(n, 1.0, 1.0), (n, 2.0, 2.0), *[(n + 1, float(i), 5.0) for i in range(20)], *[(n + 2, 1.0, float(i)) for i in range(20)]]
    df = spark.createDataFrame(rows, "key long, t double, flux double")
    got = {r.key: r for r in kernels.object_features(df, "key", block=5000).collect()}
    assert len(got) == n + 3 and all(got[n + i].bls_period is None and got[n + i].ls_peak_count is None for i in range(3))
    for k in range(n):
        t, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        base, z = t.max() - t.min(), (y - np.median(y)) / y.std()
        want = kernels.bls(t, z, 1 / np.arange(2 / base, 5, 0.1 / base**2), 0.1)
        assert np.allclose((got[k].bls_period, got[k].bls_depth), want[:2], rtol=1e-9) and got[k].ls_peak_count >= 0


def test_flat_box_searches_the_whole_grid(spark):
    got = catalogue.QUERIES["flat_box"](spark, SF).select("key", "period").distinct().toPandas()
    step = (got.period - 0.5) / (19.5 / 4999)
    assert len(got) == 5 and np.allclose(step, step.round(), atol=1e-3) and len({int(k) for k in step.round()} - {round(i * 4999 / 199) for i in range(200)}) > 2


def test_fits(spark, tmp_path):
    def header(cards):
        text = "".join(f"{c:<80}" for c in [*cards, "END"])
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    rows = np.array([(1.5, 2.0), (2.5, np.nan)], dtype=[("TIME", ">f8"), ("PDCSAP_FLUX", ">f4")])
    data = header(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0"]) + header(["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 12", "NAXIS2  = 2", "PCOUNT  = 0", "TFIELDS = 2", "TTYPE1  = 'TIME'", "TFORM1  = 'D'", "TTYPE2  = 'PDCSAP_FLUX'", "TFORM2  = 'E'"]) + rows.tobytes().ljust(2880, b"\0")
    (tmp_path / "a.fits").write_bytes(data)
    (tmp_path / "b.fits").write_bytes(b"no table")
    got = files.light_curves(spark, str(tmp_path)).orderBy("filename", "t").collect()
    assert [(r.t, r.flux) for r in got if r.error is None] == [(1.5, 2.0), (2.5, None)] and len([r for r in got if r.error]) == 1


def test_read_arrays_and_csv(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(2500, 3))
    np.save(tmp_path / "x.npy", x)
    (tmp_path / "names.txt").write_text("\n".join(f"f{i}" for i in range(len(x))) + "\n")
    got = files.read_arrays(spark, str(tmp_path / "x.npy"), str(tmp_path / "names.txt")).toPandas().set_index("filename")["vec"]
    assert len(got) == len(x) and all(np.array_equal(got[f"f{i}"], x[i]) for i in (0, 1023, 1024, 2499))
    (tmp_path / "short.txt").write_text("a\nb\n")
    with pytest.raises(ValueError):
        files.read_arrays(spark, str(tmp_path / "x.npy"), str(tmp_path / "short.txt"))
    (tmp_path / "c.csv").write_text("# note\n" * 1500 + "a,b,a\n1,2,3\n")
    assert files.read_csv(spark, str(tmp_path / "c.csv"), comment="#").collect()[0].asDict() == {"a": 1, "b": 2, "a.1": 3}
    (tmp_path / "none.csv").write_text("# note\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "none.csv"), comment="#")


def test_match_series_by_a_fitted_projection(spark):
    from pyspark.sql import functions as F

    from lightloom.operators import cluster

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "key long, vec array<double>")
    known, objects = rows.filter("key < 25"), rows.filter("key >= 25")
    model = cluster.fit_projection(known, 3)
    center, axes = x[:25].mean(0), np.linalg.svd(x[:25] - x[:25].mean(0))[2][:3]
    scores = {r.key: r.scores for r in model.apply(rows).collect()}
    assert scores[99] is None and scores[98] is None
    assert np.allclose(np.abs([scores[i] for i in range(40)]), np.abs((x - center) @ axes.T))
    labelled = model.apply(known).select("key", F.col("scores").alias("vec"), F.lit("Pl").alias("label"))
    got = {r.key: r for r in match.match_series(objects, labelled, "key", lambda s, key: s.filter("vec is not null and size(vec) = 6"), model, threshold=0.9).collect()}
    want = match.cosines((x[25:] - center) @ axes.T, (x[:25] - center) @ axes.T)
    assert sorted(got) == list(range(25, 40))
    for i in range(15):
        r = got[25 + i]
        assert r.matched == want[i].argmax() and abs(r.similarity - want[i].max()) < 1e-9 and (r.matched_label == "outlier") == (want[i].max() < 0.9)
    few = cluster.fit_projection(known.limit(3), 5)
    assert few.axes.shape == (2, 6)
    with pytest.raises(ValueError):
        cluster.fit_projection(known.limit(0), 2)
