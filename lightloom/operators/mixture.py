"""Gaussian mixtures by distributed expectation-maximisation: four shapes of covariance, plain or variational.

A round is one pass over the rows: each task adds up the responsibilities and the first and second moments of its own
rows, Spark adds up the tasks, and k * (1 + d + d * d) numbers, whatever the rows, reach the driver for the step there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPES = ("full", "tied", "diag", "spherical")
PRIORS = (None, "dirichlet_process", "dirichlet_distribution")


def summed(rows: DataFrame, vec: str, f, width: int) -> np.ndarray:
    """Sum over all rows of f(matrix of rows), a vector of ``width`` numbers; null vectors count nothing."""

    def run(batches):
        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                total += f(np.stack(pdf["v"].to_list()).astype(float))
        yield pd.DataFrame({"i": np.arange(width), "x": total})

    out = np.zeros(width)
    parts = rows.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(run, "i int, x double")
    for i, x in parts.groupBy("i").agg(F.sum("x")).collect():  # at most ``width`` rows
        out[i] = x
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 8, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out[low] -= 1 / x[low]
        x[low] += 1
    z = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


@dataclass
class Mixture:
    """log_weights [k] (expected ones if variational), means [k, d], covariances [k, d, d], offsets [k] of the log-densities."""

    log_weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    offsets: np.ndarray
    shape: str
    weights: np.ndarray
    log_likelihood: float = float("nan")
    n: int = 0
    rounds: int = 0
    converged: bool = False

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for j, (m, c) in enumerate(zip(self.means, self.covariances)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, j] = -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out + self.log_weights + self.offsets

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(of each row and component, log of each row's total)."""
        joint = self.log_joint(x)
        top = joint.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        return np.exp(joint - total[:, None]), total

    @property
    def free(self) -> int:
        k, d = self.means.shape
        own = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.shape]
        return own + k * d + k - 1

    @property
    def aic(self) -> float:
        return 2 * self.free - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.free * float(np.log(max(self.n, 1))) - 2 * self.log_likelihood

    def assign(self, points: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
        """(id, vec, label, probability) of each row with a vector: its likeliest component, ties to the smaller."""
        ask = self.responsibilities

        @F.pandas_udf("label int, probability double")
        def run(v: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"label": pd.Series(dtype="int32"), "probability": pd.Series(dtype=float)})
            r, _ = ask(np.stack(v.to_list()).astype(float))
            return pd.DataFrame({"label": r.argmax(1).astype("int32"), "probability": r.max(1)})

        rows = points.filter(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).alias("vec"))
        return rows.withColumn("_r", run("vec")).select("id", "vec", "_r.label", "_r.probability")


def _shaped(s: np.ndarray, weights: np.ndarray, shape: str) -> np.ndarray:
    """Scatter [k, d, d] cut to the shape; tied: their mean by weight."""
    k, d, _ = s.shape
    if shape == "tied":
        return np.repeat((weights[:, None, None] * s).sum(0)[None] / weights.sum(), k, axis=0)
    diagonal = np.einsum("kii->ki", s)
    if shape == "diag":
        return np.stack([np.diag(v) for v in diagonal])
    if shape == "spherical":
        return np.stack([np.eye(d) * v.mean() for v in diagonal])
    return s


def _step(nk, means, scatter, shape, floor) -> Mixture:
    """Maximum likelihood from sizes, means and mean outer products about them."""
    k, d = means.shape
    cov = _shaped(scatter, nk, shape) + floor * np.eye(d)
    w = nk / nk.sum()
    return Mixture(np.log(w), means, cov, np.zeros(k), shape, w)


def _variational_step(nk, means, scatter, shape, floor, prior, strength, center, spread) -> Mixture:
    """Mean-field posterior: a normal-Wishart prior at the data's mean and covariance, and a Dirichlet prior of the weights."""
    k, d = means.shape
    scatter = scatter + floor * np.eye(d)
    beta, nu = 1.0 + nk, d + nk
    away = means - center
    pull = np.einsum("ki,kj->kij", away, away) * (nk / beta)[:, None, None]
    total = nk[:, None, None] * scatter + pull
    if shape == "tied":
        nu = np.full(k, d + nk.sum() / k)
        cov = np.repeat((spread[None] + total.sum(0)[None] / k), k, axis=0) / nu[:, None, None]
    else:
        cov = _shaped(spread[None] + total, nk, shape) / nu[:, None, None]
    at = (center + nk[:, None] * means) / beta[:, None]
    halves = np.stack([digamma(0.5 * (nu - i)) for i in range(d)]).sum(0)
    offsets = 0.5 * (d * np.log(2.0) + halves - d * np.log(nu) - d / beta)
    if prior == "dirichlet_process":
        a, b = 1 + nk, strength + np.append(np.cumsum(nk[::-1])[-2::-1], 0.0)
        both = digamma(a + b)
        stay = digamma(b) - both
        log_w = digamma(a) - both + np.append(0.0, np.cumsum(stay)[:-1])
        w = a / (a + b) * np.append(1.0, np.cumprod(b / (a + b))[:-1])
    else:
        a = strength + nk
        log_w, w = digamma(a) - digamma(np.array([a.sum()])), a
    return Mixture(log_w, at, cov, offsets, shape, w / w.sum())


def fit(
    points: DataFrame, k: int = 3, shape: str = "full", prior: str | None = None, strength: float = 0.1, seed: int = 42, tol: float = 1e-3, most: int = 100, floor: float = 1e-6, vec: str = "vec"
) -> Mixture:
    """A mixture of ``k`` components, begun from k-means.

    shape: full, tied, diag or spherical. prior: None (maximum likelihood), dirichlet_process or dirichlet_distribution
    with the concentration ``strength`` (variational; components without rows fade). Rows with a null vector take no
    part; fewer rows than components raise ValueError.
    """
    if shape not in SHAPES or prior not in PRIORS:
        raise ValueError(f"unknown shape or prior: {shape}, {prior}")
    data = points.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("vec")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = data.select(F.size("vec")).first()
        if first is None:
            raise ValueError("no rows")
        d = first[0]
        size = 1 + d + d * d
        whole = summed(data, "vec", lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]), size)
        n, center = int(whole[0]), whole[1 : 1 + d] / whole[0]
        if n < k:
            raise ValueError(f"{n} rows for {k} components")
        spread = whole[1 + d :].reshape(d, d) / n - np.outer(center, center)
        shaped = _shaped(spread[None], np.ones(1), shape)[0] + floor * np.eye(d)
        # moments about the data's mean, so that far-off data lose no digits
        seeds = np.array(KMeans(k=k, seed=seed).fit(data.select(array_to_vector("vec").alias("features"))).clusterCenters()) - center
        k = len(seeds)

        def moments(r, x, log):
            return np.concatenate([[log], r.sum(0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x, optimize=True).ravel()])

        def nearest(x):
            x = x - center
            r = np.eye(k)[((x[:, None] - seeds) ** 2).sum(2).argmin(1)]
            return moments(r, x, 0.0)

        def step(sums):
            nk = sums[1 : 1 + k] + 10 * np.finfo(float).eps
            means = sums[1 + k : 1 + k + k * d].reshape(k, d) / nk[:, None]
            scatter = sums[1 + k + k * d :].reshape(k, d, d) / nk[:, None, None] - np.einsum("ki,kj->kij", means, means)
            if prior is None:
                return _step(nk, means, scatter, shape, floor)
            return _variational_step(nk, means, scatter, shape, floor, prior, strength, np.zeros(d), shaped)

        width = 1 + k * size
        model, before = step(summed(data, "vec", nearest, width)), -np.inf
        for done in range(1, most + 1):
            now = model

            def expect(x, now=now):
                r, log = now.responsibilities(x - center)
                return moments(r, x - center, log.sum())

            sums = summed(data, "vec", expect, width)
            now.log_likelihood, now.n, now.rounds = float(sums[0]), n, done
            if abs(sums[0] / n - before) < tol:
                now.converged = True
                break
            before = sums[0] / n
            if done < most:
                model = step(sums)
        model.means = model.means + center
        return model
    finally:
        data.unpersist()
