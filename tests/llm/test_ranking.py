"""The quality ranking against all pairs of all learning rows."""

import numpy as np
from pyspark.sql import functions as F

from lightloom.llm import quality


def wide(first):
    """``features`` with two that vary, the others 0."""
    return F.array(*[c.cast("float") for c in first], *[F.lit(0.0).cast("float")] * (quality.width() - len(first)))


def test_losses_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    up, down, reach = rng.normal(1, 3, 400), rng.normal(-1, 2, 300), 40.0
    counts = np.zeros((2, quality.CELLS))
    for k, s in enumerate((down, up)):
        low, part = quality._cells(s, reach)
        np.add.at(counts[k], low, 1 - part)
        np.add.at(counts[k], low + 1, part)
    got = quality.losses(counts, reach)
    marks = np.linspace(-reach, reach, quality.CELLS)
    prefer = lambda a, b: 1 / (1 + np.exp(b - a))
    for at in (2000, 4000, 4300):
        assert np.isclose(got[1][at], prefer(down, marks[at]).mean(), atol=1e-5)
        assert np.isclose(got[0][at], prefer(marks[at], up).mean(), atol=1e-5)


def test_every_learning_row_counts(spark):
    n = 21_000  # more than the 20,000 that a sample once held
    rows = spark.range(n).select(F.col("id").alias("doc_id"), wide([F.rand(1) + F.col("id") % 3 / 4, F.rand(2)]).alias("features")).localCheckpoint()
    marks = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    model = quality.fit(rows, marks)
    x, y = (np.array(c) for c in zip(*[(r.features[:2], r.y) for r in rows.join(marks, "doc_id").collect()]))
    assert np.allclose(model.mean[:2], x.mean(0), rtol=1e-12) and np.allclose(model.scale[:2], x.std(0), rtol=1e-12)
    worth = ((x - x.mean(0)) / x.std(0)) @ model.weights[:2]
    assert (worth > model.threshold).sum() == (y == 1).sum()
    # the weights are where the slope over all pairs ends: compared with the slope at no weights
    z = (x - x.mean(0)) / x.std(0)

    def slope(weights):
        s = z @ weights
        up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        p = 1 / (1 + np.exp(s[up][:, None] - s[down][None, :]))
        return -(p.mean(1) @ z[up]) / len(up) + (p.mean(0) @ z[down]) / len(down) + 1e-4 * weights

    assert np.abs(slope(model.weights[:2])).max() < 0.01 * np.abs(slope(np.zeros(2))).max()
