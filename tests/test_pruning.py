"""Matches with blocks left out, vectors that don't fit, the sky's seams, variants without scores, recall steps and the SQL front."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lightloom.operators import match, relational
from lightloom.plans.sqlfront import run_sql


def clustered(rng, n, centres):
    x = centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, centres.shape[1]))
    return x * rng.uniform(0.5, 2.0, (n, 1))


@pytest.mark.parametrize("digits", [None, 2])
def test_blocks_that_cannot_hold_a_winner_never_meet(spark, monkeypatch, digits):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    x, y = clustered(rng, 300, centres), clustered(rng, 260, centres)
    y[7], x[5], y[100] = y[6], 0.0, 0.0
    frame = lambda a, name: spark.createDataFrame([(f"{name}{i:03d}", v.tolist(), f"l{i % 4}") for i, v in enumerate(a)], "filename string, vec array<double>, label string").repartition(3)
    objects, labelled = frame(x, "x").drop("label"), frame(y, "y")
    sims = match.cosines(x, y)
    sims = np.round(sims, digits) if digits else sims
    for pairs in (64, 0):
        monkeypatch.setattr(match, "PAIRS", pairs)
        got = {r.filename: r for r in match.cosine_top1(objects, labelled, digits=digits, block=16).collect()}
        assert len(got) == 300
        for i in range(300):
            r = got[f"x{i:03d}"]
            best = sims[i].max()
            assert abs(r.similarity - best) < 1e-12 and (digits is None or r.matched == f"y{int(np.flatnonzero(sims[i] == best)[0]):03d}")
            assert sims[i, int(r.matched[1:])] > best - 1e-12 and r.matched_label == f"l{int(r.matched[1:]) % 4}"
    keep = F.col("vec") if digits else F.col("vec")
    left = objects.filter("filename <> 'x005'").select(F.col("filename").alias("k"), keep.alias("v"))
    _, pairs = match.nearest_by_angle(left, labelled.select(F.col("filename").alias("k"), F.col("vec").alias("v"), "label"), digits, 16)
    told = pairs.agg(F.count("*").alias("n"), F.count_if("met").alias("met")).first()
    assert told.met < 0.5 * told.n


def test_vectors_that_do_not_fit(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0]), ("c", [float("nan"), 1.0]), ("d", None), ("e", [0.0, 2.0]), ("f", [1.0, None])]
    df = spark.createDataFrame(rows, "filename string, vec array<double>")
    labelled = spark.createDataFrame([("p", [2.0, 0.1], "one"), ("q", [0.0, 1.0], "two"), ("r", [9.0, 9.0, 9.0], "three"), ("s", [float("inf"), 0.0], "four")], "filename string, vec array<double>, label string")
    got = {r.filename: r for r in match.cosine_top1(df, labelled).collect()}
    assert set(got) == set("abcdef") and got["a"].matched == "p" and got["e"].matched == "q" and got["d"].similarity == 0
    assert all(got[k].matched is None and got[k].similarity is None for k in "bcf")


def test_sky_cells(spark):
    rng = np.random.default_rng(5)
    def sphere(n):
        ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
        ra[:6], dec[:6] = [0.0, 359.9999, 0.001, 10.0, 200.0, 90.0], [0.0, 0.0, 45.0, 89.9, 89.95, -89.99]
        return ra, dec
    (ra, dec), (sra, sdec) = sphere(400), sphere(900)
    radius = 2.5
    objects = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(ra, dec))] + [(999, None, 1.0)], "id int, ra double, dec double")
    stars = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(sra, sdec))] + [(999, 1.0, float("nan"))], "star int, ra double, dec double")
    got = {r.id: (r.star, r.distance) for r in relational.sky_nearest(objects, stars, radius).collect()}
    p, q = ([np.cos(np.radians(d)) * np.cos(np.radians(a)), np.cos(np.radians(d)) * np.sin(np.radians(a)), np.sin(np.radians(d))] for a, d in ((ra, dec), (sra, sdec)))
    apart = np.degrees(2 * np.arcsin(np.clip(np.sqrt(((np.array(p).T[:, None] - np.array(q).T[None]) ** 2).sum(2)) / 2, 0, 1)))
    want = {i: apart[i].min() for i in range(400) if apart[i].min() <= radius}
    assert got.keys() == want.keys() and len(want) > 100 and all(abs(got[i][1] - want[i]) < 1e-6 and apart[i, got[i][0]] < want[i] + 1e-6 for i in want)
    plan = relational.sky_nearest(objects, stars, radius)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_variants_without_scores_stay(spark):
    rows = [("a", float(i), int(i % 3 == 0)) for i in range(40)] + [("none", None, 1), ("none", None, 0)] + [(None, float(i), 1) for i in range(10)]
    got = {r.variant: r for r in relational.variant_report(spark.createDataFrame(rows, "variant string, score double, is_flagged int"), 20).collect()}
    assert set(got) == {"a", "none", None} and got["none"].n_total == 2 and got["none"].n_thresholded == 0 and got["a"].n_thresholded == 8 and got[None].n_thresholded == 2


def test_recall_steps(spark):
    rng = np.random.default_rng(2)
    n = {"a": 37, "b": 100, "c": 3}
    df = pd.DataFrame([(v, i + 1, n[v], int(rng.random() < 0.4), float(rng.random())) for v in n for i in range(n[v])], columns=["v", "rn", "n", "f", "w"])
    got = {(r.v, r.pct): r for r in relational.recall_curve(spark.createDataFrame(df), F.col("f") == 1, "w", ["v"]).collect()}
    assert len(got) == 60
    for (v, pct), r in got.items():
        part = df[df.v == v]
        top = part[part.rn <= n[v] * pct // 100]
        hit = top[top.f == 1]
        assert r.k == n[v] * pct // 100 and r.hits == len(hit) and np.isclose(r.recall, len(hit) / max(1, part.f.sum())) and (r.mean_weight is None if hit.empty else np.isclose(r.mean_weight, hit.w.mean(), atol=1e-9))


@pytest.mark.parametrize(
    "query, rows",
    [
        ("SELECT `like` FROM input_df WHERE name LIKE 'AB%'", [(1,), (2,)]),
        ("SELECT like FROM input_df WHERE like > 1 AND name NOT LIKE 'zz%' ORDER BY like", [(2,)]),
        ("SELECT count(*) FROM input_df i WHERE i.name like 'a%' -- LIKE input_df 'x'\n", [(2,)]),
        ("SELECT max(input_df.like) AS `input_df` FROM input_df /* FROM input_df */ WHERE NOT name LIKE 'Q%'", [(3,)]),
        ("SELECT name FROM input_df WHERE like IN (SELECT max(like) FROM input_df)", [("zz like input_df",)]),
        ("SELECT like FROM input_df WHERE name = 'zz like input_df'", [(3,)]),
        ("SELECT sum(like / 0) FROM input_df", [(None,)]),
    ],
)
def test_sql_front(spark, query, rows):
    df = spark.createDataFrame([(1, "abc"), (2, "Abd"), (3, "zz like input_df")], "like int, name string")
    assert [tuple(r) for r in run_sql(df, query, compat=True).collect()] == rows
