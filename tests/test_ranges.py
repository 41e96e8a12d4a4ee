"""Light curves read by ranges of rows, and the centroid test on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.operators import series
from lightloom.sources import files


def fits(columns: dict[str, np.ndarray], kinds: dict[str, str] | None = None) -> bytes:
    """A file with one binary table of doubles, or of the kinds given."""

    def header(cards):
        text = "".join(f"{c:<80}" for c in [*cards, "END"])
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    kinds = kinds or {}
    code = {"D": ">f8", "E": ">f4", "J": ">i4"}
    count = len(next(iter(columns.values())))
    rows = np.zeros(count, dtype=[(c, code[kinds.get(c, "D")]) for c in columns])
    for c, v in columns.items():
        rows[c] = v
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {rows.dtype.itemsize}", f"NAXIS2  = {count}", "PCOUNT  = 0", f"TFIELDS = {len(columns)}"]
    for i, c in enumerate(columns, 1):
        cards += [f"TTYPE{i}  = '{c}'", f"TFORM{i}  = '{kinds.get(c, 'D')}'"]
    data = rows.tobytes()
    return header(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0"]) + header(cards) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def curve(seed: int, n: int, shifted: bool) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 27, n))
    phase = (t % 3.1) / 3.1
    dip = np.abs(phase - 0.75) < 0.05
    flux = 1 - 0.02 * dip + 1e-4 * rng.normal(size=n)
    out = {"TIME": t, "CADENCENO": np.arange(n), "PDCSAP_FLUX": flux, "MOM_CENTR1": 5 + 0.03 * dip * shifted + 1e-4 * rng.normal(size=n)}
    out |= {c: rng.normal(size=n) for c in ("MOM_CENTR2", "POS_CORR1", "POS_CORR2")}
    out["MOM_CENTR2"] = 1e-4 * out["MOM_CENTR2"]
    out["POS_CORR1"][::17] = np.nan
    out["PDCSAP_FLUX"][5] = np.inf
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("curves")
    made = {"one.fits": curve(1, 3000, True), "two.fits": curve(2, 700, False)}
    for name, columns in made.items():
        (out / name).write_bytes(fits(columns, {"CADENCENO": "J", "PDCSAP_FLUX": "E"}))
    whole = (out / "one.fits").read_bytes()
    (out / "cut.fits").write_bytes(whole[: len(whole) // 2])
    (out / "none.fits").write_bytes(b"no table")
    (out / "empty.fits").write_bytes(fits({"TIME": np.zeros(0), **{c: np.zeros(0) for c in files.CENTROIDS}}))
    (out / "lacks.fits").write_bytes(fits({"TIME": np.zeros(3)}))
    (out / "notes.txt").write_text("no curve")
    return str(out), made


def test_ranges_of_rows(spark, folder):
    path, made = folder
    got = files.light_curve_ranges(spark, path, columns=files.CENTROIDS, task_bytes=4096)
    rows = got.withColumn("part", F.spark_partition_id()).toPandas()
    good = rows[rows.error.isna()]
    assert good[good.filename == "one.fits"].part.nunique() > 2  # one file is read by several tasks
    assert sorted(rows.filename[rows.error.notna()]) == ["cut.fits", "lacks.fits", "none.fits"] and set(good.filename) == set(made)
    for name, columns in made.items():
        own = good[good.filename == name].sort_values("t")
        assert len(own) == len(columns["TIME"])
        for column, to in {"TIME": "t", **files.CENTROIDS}.items():
            want = columns[column].astype(">f4").astype(float) if column == "PDCSAP_FLUX" else columns[column]
            assert np.array_equal(own[to], np.where(np.isfinite(want), want, np.nan), equal_nan=True)


def test_flux_alone_equals_whole_files(spark, folder):
    path, _ = folder
    a = files.light_curve_ranges(spark, path, task_bytes=1 << 14).filter("error IS NULL")
    b = files.light_curves(spark, path).filter("error IS NULL")
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 3700


def test_a_range_that_fails_is_marked(spark, folder):
    path, made = folder

    def opened(name):
        file = files.open_file(name)
        seek = file.seek

        class Broken:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def seek(self, at):
                self.at = at
                seek(at)

            def read(self, n):
                if self.at > 100_000:
                    raise OSError("gone")
                return file.read(n)

        return Broken()

    rows = files.light_curve_ranges(spark, path, columns=files.CENTROIDS, pattern="one.fits", task_bytes=50_000, opened=opened).toPandas()
    lost = rows[rows.error.notna()]
    assert len(lost) and lost.error.str.contains("gone").all() and 0 < rows.error.isna().sum() < len(made["one.fits"]["TIME"])


def test_centroids_of_files(spark, folder):
    path, made = folder
    curves = files.light_curve_ranges(spark, path, columns=files.CENTROIDS, joint=True, task_bytes=8192)
    assert curves.filter("error IS NULL AND (pos_x IS NULL OR flux IS NULL)").isEmpty()
    periods = spark.createDataFrame([("one.fits", 3.1), ("two.fits", 3.1), ("cut.fits", 3.1), ("none.fits", None)], "filename string, best_period double")
    got = {r["filename"]: r for r in series.centroid_test(curves, periods).collect()}
    assert set(got) == set(made) and got["one.fits"]["multi_source"] and not got["two.fits"]["multi_source"]
    for name, columns in made.items():
        x = {c: v.astype(">f4").astype(float) if c == "PDCSAP_FLUX" else v for c, v in columns.items()}
        whole = np.all([np.isfinite(x[c]) for c in ("TIME", *files.CENTROIDS)], axis=0)
        phase = (x["TIME"][whole] % 3.1) / 3.1
        inside, outside = np.abs(phase - 0.75) < 0.05, np.abs(phase - 0.75) > 0.1
        mom, flux = x["MOM_CENTR1"][whole], x["PDCSAP_FLUX"][whole]
        assert np.isclose(got[name]["delta_x"], mom[inside].mean() - mom[outside].mean()) and np.isclose(got[name]["depth"], np.median(flux[outside]) - np.median(flux[inside]))
        assert np.isclose(got[name]["corr_x"], np.corrcoef(flux, x["POS_CORR1"][whole])[0, 1])


def test_no_files(spark, tmp_path):
    assert files.light_curve_ranges(spark, str(tmp_path)).isEmpty()
