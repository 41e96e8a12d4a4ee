"""Work and rows that must not grow with products of large tables."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from lightloom.operators import cluster, kernels, match, relational, subsets


def test_boxes_of_many_points_are_found_by_bisection(monkeypatch):
    rng = np.random.default_rng(0)
    few = np.sort(rng.uniform(3, 15, 2000))
    for t in (np.sort(rng.uniform(0, 12, 60_000)), np.repeat(few, 40), np.arange(60_000) / 4000):  # the last ones lie on the bins' edges
        t, y = t - t[0], rng.normal(size=len(t))
        periods = np.append(1 / np.linspace(0.3, 5, 40), [0.25, 0.5, 2.0])
        bins = kernels.box_bins(periods, 0.1, 10)
        blocks = list(kernels.box_blocks(bins))
        plain = [kernels.box_histogram(t, y, periods[b], bins[b], 10) for b in blocks]
        for order in (np.arange(len(t)), rng.permutation(len(t))):
            for found, want in zip(kernels.histograms(t[order], y[order], periods, bins, 10, blocks), plain, strict=True):
                assert (found[0] == want[0]).all() and np.allclose(found[1], want[1], atol=1e-9)
    y = np.where(np.arange(60_000) / 4000 % 1.5 < 0.1, 0.9, 1.0)

    def all_points(*_):
        raise AssertionError("every point was looked at for every period")

    monkeypatch.setattr(kernels, "box_histogram", all_points)
    assert abs(kernels.bls(t, y, np.linspace(1.0, 2.0, 501), 0.1)[0] - 1.5) < 1e-9


@pytest.mark.parametrize("part", [1_000_000, 150])
def test_flat_boxes_of_series_in_parts(spark, part):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(2):
        t = np.sort(rng.uniform(5, 35, 900))
        y = np.where((t % (1.3 + k)) < 0.2, 9.0, 10.0) + 0.01 * rng.normal(size=900)
        rows += [(k, float(a), float(b)) for a, b in zip(t, y)]
        z = (kernels.flatten((y - y.mean()) / y.std() + 100.0, 401) - 1.0) * 100.0
        period, depth, power, epoch = kernels.bls(t, z, np.linspace(0.5, 20, 700), 0.1)
        want[k] = period, depth, power, epoch, (t - epoch + period / 2) % period / period - 0.5, np.clip(z, -6.0, 3.0)
    rows += [(None, i / 40, float(i % 5)) for i in range(300)] + [(8, float(i), 2.0) for i in range(200)] + [(9, None, 1.0), (9, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key long, t double, flux double").repartition(4)
    got = kernels.flat_box(df, "key", periods=700, part=part, size=300).toPandas()
    assert set(got["key"].dropna()) == {0, 1} and got["key"].isna().sum() == 300
    for k, (*box, phase, z) in want.items():
        rows = got[got["key"] == k].sort_values("phase")
        order = np.argsort(phase)
        assert np.allclose(rows[["period", "depth", "power", "epoch"]], np.array(box)) and np.allclose(rows["phase"], phase[order]) and np.allclose(rows["z"], z[order])


@pytest.mark.parametrize("d", [2, 3])
def test_dense_regions_are_no_table_of_pairs(spark, monkeypatch, d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, 0.15, (400, d)), rng.normal(2.5, 0.2, (150, d)), rng.uniform(-4, 6, (60 * d, d)), np.linspace(0.5, 2.2, 18)[:, None].repeat(d, 1) + 0.02, np.full((40, d), -3.0)])
    x = x[rng.permutation(len(x))]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9000, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    plain = {(e, m): {r.id: r.label for r in cluster._dense(cluster.cut(cluster.neighbours(df, e, "id", "vec")), df.select("id"), m).collect()} for e, m in ((0.25, 5),)}

    def pairs(*_):
        raise AssertionError("all pairs within eps were made")

    monkeypatch.setattr(cluster, "neighbours", pairs)
    for heads in (16, 1):  # with one head, most cells come together by all their points
        monkeypatch.setattr(cluster, "HEADS", heads)
        for (e, m), want in plain.items():
            assert {r.id: r.label for r in cluster.dbscan(df, e, m).collect()} == want and len(set(want.values())) > 2


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    names, out = sorted(set(labels)), []
    labels = np.array(labels)
    for i in range(len(x)):
        means = {n: d[i, labels == n].sum() / ((labels == n).sum() - (n == labels[i])) if (labels == n).sum() > (n == labels[i]) else None for n in names}
        a, b = means.pop(labels[i]), [v for v in means.values() if v is not None]
        out.append(0.0 if a is None or not b or max(a, min(b)) == 0 else (min(b) - a) / max(a, min(b)))
    return np.mean(out)


@pytest.mark.parametrize("wide", [3, 20])
def test_silhouettes_move_blocks_and_not_sums_by_label(spark, monkeypatch, wide):
    rng = np.random.default_rng(wide)
    labels = [f"l{i}" for i in rng.permutation([0] * 90 + [1] * 40 + list(range(2, 40)) + [50] * 7 + [51] * 5 + list(range(60, 70)) * 2)]
    x = rng.normal(size=(len(labels), wide)) + np.array([[hash(v) % 7] for v in labels])
    x[5] = x[6]  # a copy
    rows = spark.createDataFrame([(i, v, [float(c) for c in r]) for i, (v, r) in enumerate(zip(labels, x))] + [(999, None, [0.0] * wide)], "id long, label string, vec array<double>").repartition(3)
    for strip, block in ((1 << 18, 2048), (1 << 18, 17), (100, 30), (450, 7)):
        monkeypatch.setattr(subsets, "STRIP", strip)
        names = [f"x{i}" for i in range(wide)]
        flat = rows.selectExpr("id", "label", *[f"vec[{i}] as {c}" for i, c in enumerate(names)])
        got = subsets.silhouettes(flat, names, F.col("label"), least=wide, block=block).first()
        assert abs(got.silhouette - plain_silhouette(x, labels)) < 1e-9 and got.n == len(labels)
    one = subsets.silhouettes(flat.withColumn("label", F.lit(1)), names, F.col("label"), least=wide, block=block).first()
    assert one.silhouette == 0 and one.n == len(labels) + 1


def test_positions_meet_once(spark):
    stars = spark.createDataFrame([(100 * c + p, 10.0 + p / 10, 5.0) for p in range(5) for c in range(30)], "star long, ra double, dec double")
    objects = spark.createDataFrame([(100 * c + p, 10.02 + p / 10, 5.0) for p in range(4) for c in range(40)] + [(9999, None, 5.0)], "id long, ra double, dec double")
    assert relational.sky_pairs(objects, stars, 0.05).count() == 4
    got = {r.id: r.star for r in relational.sky_nearest(objects, stars, 0.05).collect()}
    assert got == {100 * c + p: p for p in range(4) for c in range(40)}


def test_stacked_vectors_are_handed_on_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    t, y = np.sort(rng.uniform(0, 20, 5000)), rng.normal(size=5000)
    f = np.logspace(-1, 0.5, 300)
    c, s = np.cos(2 * np.pi * f[:, None] * t), np.sin(2 * np.pi * f[:, None] * t)
    z = y - y.mean()
    fit = [np.linalg.lstsq(np.stack([np.ones(5000), a, b], axis=1), z, rcond=None) for a, b in zip(c, s)]
    assert np.allclose(match.gls(t, y, f), [1 - r[1][0] / (z @ z) for r in fit], atol=1e-9)
    most = []
    monkeypatch.setattr(match.np, "cos", lambda a, cos=np.cos: most.append(a.size) or cos(a))
    match.gls(t, y, f)
    assert max(most) <= 1 << 20
    monkeypatch.undo()
    rows = spark.createDataFrame([(k, float(i), float((i * k) % 5)) for k in range(600) for i in range(4)], "key long, t double, flux double").coalesce(1)
    sizes = match.flux_power_stack(rows, "key", 3000, 10).mapInPandas(lambda b: (pd.DataFrame({"n": [len(p)]}) for p in b), "n long")
    assert sizes.agg(F.sum("n")).first()[0] == 600


def test_blocks_move_once_a_tile(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(150, 12)), rng.normal(size=(400, 12))
    b[300:] = b[:100]  # ties
    left = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(a)], "k long, v array<double>").repartition(3)
    right = spark.createDataFrame([(1000 + i, [float(c) for c in v], f"l{i}") for i, v in enumerate(b)], "k long, v array<double>, label string").repartition(3)
    want = match.cosines(a, b)
    dealt = []
    repartition = type(left).repartition
    for tile in (16, 3, 1):
        monkeypatch.setattr(match, "TILE", tile)
        moved = []
        monkeypatch.setattr(type(left), "repartition", lambda self, *at: (moved.append(self) if "gx" in at else None) or repartition(self, *at))
        got = {r.key: r for r in match.nearest_by_angle(left, right, 9, block=20)[0].collect()}
        monkeypatch.setattr(type(left), "repartition", repartition)
        assert len(got) == 150 and all(got[i].matched == 1000 + np.round(want[i], 9).argmax() and got[i].matched_label == f"l{got[i].matched - 1000}" for i in range(150))
        dealt.append(moved[-1].count())  # blocks that move for the pairs left by the bounds
    assert dealt[0] < dealt[1] < dealt[2] / 2
