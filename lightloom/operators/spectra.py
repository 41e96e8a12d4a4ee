"""Periodograms over regular grids by non-uniform Fourier transforms, of series of any length.

Floating-mean power needs six means at each frequency; all follow from three Fourier sums over a series' points: of the
values, of ones, and of ones at twice the frequencies. Points are spread over a regular grid of cells with a Gaussian, one
transform a sum gives all frequencies at once, and a factor takes the Gaussian out again (Dutt & Rokhlin 1993; Greengard &
Lee 2004). Spreading is a sum, so the points of a long series are spread by many tasks, whose cells Spark adds up; short series are
spread where they are transformed. Work grows with points plus frequencies, not with their product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..components import settled
from ..functions import exprs as X

#: Cells on each side of a point: errors are about 1e-12 of the number of points.
WIDTH = 12
#: Series with more points than these are spread by many tasks.
LONG = 50_000


def grids(series: DataFrame, key: str, low_period: float, high_period: float, samples: int) -> DataFrame:
    """(key, t0, centre, points, yy, f0, df, n): each series' regular grid, from 1 / high_period in steps of 1 / (baseline * samples), and its sums."""
    rows = series.filter(X.finite("t", "flux"))
    told = rows.groupBy(key).agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("_T"), F.avg("flux").alias("centre"), F.count("*").alias("points"), F.var_pop("flux").alias("yy")).filter("_T > 0")
    df = 1.0 / (F.col("_T") * samples)
    n = F.round((F.lit(1.0 / low_period) - F.lit(1.0 / high_period)) / df).cast("int") + 1
    return told.select(key, "t0", "centre", "points", "yy", F.lit(1.0 / high_period).alias("f0"), df.alias("df"), n.alias("n"))


def size_of(n: int) -> int:
    """Cells for n frequencies: a power of two, twice as many at least, and enough for the Gaussian not to meet itself."""
    return max(1 << (2 * n - 1).bit_length(), 4 * WIDTH)


def _width_of(n: int, size: int) -> float:
    ratio = size / n
    return np.pi * WIDTH / (n * n * ratio * (ratio - 0.5))


def spread(t: np.ndarray, w: np.ndarray, f0: float, df: float, n: int) -> np.ndarray:
    """The cells [size] of points at t with weights w."""
    size = size_of(n)
    turn = 2 * np.pi / size
    x = 2 * np.pi * np.mod(df * t, 1.0)
    v = w * np.exp(-2j * np.pi * np.mod((f0 + n // 2 * df) * t, 1.0))
    tau, near = _width_of(n, size), np.floor(x / turn).astype(int)
    out = np.zeros(size, dtype=complex)
    for k in range(1 - WIDTH, WIDTH + 1):
        g = np.exp(-((x - (near + k) * turn) ** 2) / (4 * tau))
        at = (near + k) % size
        out += np.bincount(at, g * v.real, size) + 1j * np.bincount(at, g * v.imag, size)
    return out


def sums(cells: np.ndarray, n: int) -> np.ndarray:
    """Fourier sums [n] at f0, f0 + df, ... from the cells."""
    size = len(cells)
    tau, m = _width_of(n, size), np.arange(n) - n // 2
    return np.sqrt(np.pi / tau) * np.exp(m * m * tau) * (np.fft.fft(cells) / size)[m % size]


def three(t: np.ndarray, y: np.ndarray, f0: float, df: float, n: int) -> np.ndarray:
    """[3, size]: cells of the values, of ones, and of ones at twice the frequencies."""
    one = np.ones(len(t))
    return np.stack([spread(t, y, f0, df, n), spread(t, one, f0, df, n), spread(t, one, 2 * f0, 2 * df, n)])


def power_of(cells: np.ndarray, points: int, yy: float, n: int) -> np.ndarray:
    """Floating-mean power [n], NaN where it is not defined; yy: the variance of the values, whose mean is 0."""
    sy, s1, s2 = (sums(c, n) / points for c in cells)
    yc, ys, c, s = sy.real, -sy.imag, s1.real, -s1.imag
    cc, ss, cs = (1 + s2.real) / 2 - c * c, (1 - s2.real) / 2 - s * s, -s2.imag / 2 - c * s
    d = cc * ss - cs * cs
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * d)
    return np.where((yy > 1e-300) & (np.abs(d) > 1e-12), out, np.nan)


def power(series: DataFrame, key: str, grid: DataFrame, long: int | None = None) -> DataFrame:
    """(key, i, f, power) at each frequency of ``grid`` (see ``grids``), null where it is not defined."""
    grid = settled(grid)
    long = LONG if long is None else long
    facts = ["t0", "centre", "points", "yy", "f0", "df", "n"]
    rows = series.filter(X.finite("t", "flux")).select(key, "t", "flux").join(grid, key)
    kind = series.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, i int, f double, power double"

    def table(name, facts, cells) -> pd.DataFrame:
        n = int(facts["n"])
        found = power_of(cells, facts["points"], facts["yy"], n)
        return pd.DataFrame({key: name, "i": np.arange(n, dtype=np.int32), "f": facts["f0"] + np.arange(n) * facts["df"], "power": pd.array(np.where(np.isnan(found), None, found), dtype="Float64")})

    def short(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return table(first[key], first, three(pdf["t"].to_numpy() - first["t0"], pdf["flux"].to_numpy() - first["centre"], first["f0"], first["df"], int(first["n"])))

    def scattered(batches):
        held: dict = {}
        for pdf in batches:
            for name, part in pdf.groupby(key, sort=False, dropna=False):
                first = part.iloc[0]
                name = None if pd.isna(name) else name
                cells = three(part["t"].to_numpy() - first["t0"], part["flux"].to_numpy() - first["centre"], first["f0"], first["df"], int(first["n"]))
                if name in held:
                    held[name] += cells
                else:
                    held[name] = cells
                if sum(c.size for c in held.values()) > 1 << 22:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held):
        for name, cells in held.items():
            which, at = np.nonzero(cells)
            yield pd.DataFrame({key: name, "which": which, "at": at, "re": cells[which, at].real, "im": cells[which, at].imag})

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        cells = np.zeros((3, size_of(int(first["n"]))), dtype=complex)
        cells[pdf["which"], pdf["at"]] = pdf["re"] + 1j * pdf["im"]
        return table(first[key], first, cells)

    few = rows.filter(F.col("points") <= long).groupBy(key).applyInPandas(short, schema)
    cells = rows.filter(F.col("points") > long).select(key, "t", "flux", *facts).mapInPandas(scattered, f"{key} {kind}, which int, at int, re double, im double")
    cells = cells.groupBy(key, "which", "at").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).join(grid, key)
    many = cells.groupBy(key).applyInPandas(gathered, schema)  # as many rows as cells, whatever the points
    return few.unionByName(many)
