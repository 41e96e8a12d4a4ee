"""Irregular series: cleaning, periodograms, folding, binning, shape features. A series table is (key, t, flux)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..components import cut
from ..functions import exprs as X
from . import spectra
from .ranks import beside, medians


def stats(series: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Points, mean, population deviation, median and range of each series with at least so many finite points."""
    rows = series.filter(X.finite("t", "flux"))
    told = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("flux").alias("mean"), F.stddev_pop("flux").alias("std"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    told = beside(told.filter(F.col("n") >= least), medians(rows, "flux", [key]), [key])
    return told.select(key, "n", "mean", "std", "median", "t_min", "t_max")


def median_normalise(series: DataFrame, key: str) -> DataFrame:
    """Finite points with flux / median flux of their series; null where the median is 0."""
    rows = series.filter(X.finite("t", "flux"))
    return rows.join(medians(rows, "flux", [key], "_m"), key).withColumn("flux", F.when(F.col("_m") != 0, F.col("flux") / F.col("_m"))).drop("_m")


def zscore(series: DataFrame, key: str, robust: bool = False, least: int = 1) -> DataFrame:
    """Adds z: (flux - mean or median) / population deviation; 0 for a constant series."""
    rows = series.filter(X.finite("t", "flux"))
    ends = rows.groupBy(key).agg(F.avg("flux").alias("_c"), F.stddev_pop("flux").alias("std"), F.count("*").alias("_n"))
    if robust:
        ends = ends.drop("_c").join(medians(rows, "flux", [key], "_c"), key)
    s = ends.filter(F.col("_n") >= least).drop("_n")
    return series.filter(X.finite("t", "flux")).join(s, key).withColumn("z", F.when(F.col("std") > 0, (F.col("flux") - F.col("_c")) / F.col("std")).otherwise(F.lit(0.0))).drop("_c", "std")


def periodogram(series: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    """(key, i, f, power): floating-mean Lomb-Scargle power at the frequencies of grid (i, f), or (key, i, f).

    Closed form over six means a series and frequency. Over a shared grid, a parameter's size, tasks sum them up in numpy
    before anything moves; over grids of the series' own, Spark's partial sums do.
    """
    rows = series.filter(X.finite("t", "flux")).select(key, "t", "flux")
    if key not in grid.columns:
        return _shared_grid(rows, key, grid)
    grid = grid.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "f"))).alias("g"))  # a row a series, with its frequencies in order
    pairs = rows.join(grid, key).select(key, "t", "flux", F.inline("g"))
    a = F.lit(2 * math.pi) * F.col("f") * F.col("t")
    pairs = pairs.withColumn("c", F.cos(a)).withColumn("s", F.sin(a))
    y, c, s = F.col("flux"), F.col("c"), F.col("s")
    m = pairs.groupBy(key, "i", "f").agg(
        *[F.avg(e).alias(n) for n, e in dict(ym=y, cm=c, sm=s, yy=y * y, yc=y * c, ys=y * s, cc=c * c, ss=s * s, cs=c * s).items()]
    )
    return m.select(key, "i", "f", _power().alias("power"))


#: Numbers that a task holds before it hands its sums on.
HELD = 8_000_000


def _shared_grid(rows: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    marks = [(r["i"], r["f"]) for r in grid.select("i", "f").orderBy("i").collect()]
    f = np.array([m[1] for m in marks])
    names = ["c", "s", "yc", "ys", "cc", "cs"]

    def out(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(k, *head, *sums) for k, (head, sums) in held.items()], columns=["key", "n", "y", "yy", *names])

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("key", sort=False, dropna=False):
                t, y = part["t"].to_numpy(), part["flux"].to_numpy()
                k = None if pd.isna(k) else k
                head, sums = held.setdefault(k, (np.zeros(3), np.zeros((6, len(f)))))
                head += len(y), y.sum(), (y * y).sum()
                for at in range(0, len(t), 512):
                    a, v = 2 * math.pi * t[at : at + 512, None] * f, y[at : at + 512]
                    c, s = np.cos(a), np.sin(a)
                    sums += c.sum(0), s.sum(0), v @ c, v @ s, (c * c).sum(0), (c * s).sum(0)
                if len(held) * 6 * len(f) > HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, n double, y double, yy double, " + ", ".join(f"{n} array<double>" for n in names)
    sums = rows.withColumnRenamed(key, "key").mapInPandas(run, schema)
    each = sums.select("key", "n", "y", "yy", F.posexplode(F.arrays_zip(*names)).alias("at", "z")).groupBy("key", "at")
    total = each.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("y", "yy")], *[F.sum(f"z.{c}").alias(c) for c in names])
    n = F.col("n")
    means = total.select("key", "at", *[(F.col(c) / n).alias(m) for c, m in dict(y="ym", c="cm", s="sm", yy="yy", yc="yc", ys="ys", cc="cc", cs="cs").items()]).withColumn("ss", F.lit(1.0) - F.col("cc"))
    named = rows.sparkSession.createDataFrame([(j, *m) for j, m in enumerate(marks)], f"at int, i {grid.schema['i'].dataType.simpleString()}, f double")
    return means.join(F.broadcast(named), "at").select(F.col("key").alias(key), "i", "f", _power().alias("power"))


def _power():
    v = {n: F.expr(e) for n, e in dict(YY="yy-ym*ym", YC="yc-ym*cm", YS="ys-ym*sm", CC="cc-cm*cm", SS="ss-sm*sm", CS="cs-cm*sm").items()}
    d = v["CC"] * v["SS"] - v["CS"] * v["CS"]
    up = v["SS"] * v["YC"] * v["YC"] + v["CC"] * v["YS"] * v["YS"] - F.lit(2.0) * v["CS"] * v["YC"] * v["YS"]
    return F.when((v["YY"] > 1e-300) & (F.abs(d) > 1e-300), up / (v["YY"] * d))


def regular_grid(series: DataFrame, key: str, low_period: float, high_period: float, samples: int) -> DataFrame:
    """(key, i, f): from 1/high to 1/low in steps of 1 / (baseline * samples)."""
    base = series.filter(X.finite("t", "flux")).groupBy(key).agg((F.max("t") - F.min("t")).alias("_T")).filter("_T > 0")
    df = F.lit(1.0) / (F.col("_T") * samples)
    n = F.round((F.lit(1.0 / low_period) - F.lit(1.0 / high_period)) / df).cast("int")
    return base.withColumn("i", F.explode(F.sequence(F.lit(0), n))).select(key, "i", (F.lit(1.0 / high_period) + F.col("i") * df).alias("f"))


def best_period(power: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """(key, best_period, peak_power): ties to the smaller frequency; powers are compared at nine decimals."""
    best = power.filter("power is not null").groupBy(key).agg(F.max(F.struct(F.round("power", 9).alias("p"), (-F.col("i")).alias("i"), F.col("f"))).alias("b"))
    return best.select(key, (F.lit(1.0) / F.col("b.f")).alias("best_period"), F.col("b.p").alias("peak_power")).filter(F.col("peak_power") >= threshold)


def fold(series: DataFrame, key: str, periods: DataFrame, shift: float = 0.0, least: int = 1) -> DataFrame:
    """(key, phase, z) at each series' best_period."""
    return zscore(series, key, least=least).join(periods.select(key, "best_period"), key).select(key, "t", X.phase("t", F.col("best_period"), shift).alias("phase"), "z")


def bins(folded: DataFrame, key: str, n: int = 100, value: str = "z") -> DataFrame:
    """(key, bin, center, mean, points): equal bins between the smallest and largest phase, the last one closed; empty ones are null."""
    ends = folded.groupBy(key).agg(F.min("phase").alias("_lo"), F.max("phase").alias("_hi"))
    at = F.least(F.floor((F.col("phase") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / n)) + 1, F.lit(n))
    means = folded.join(ends, key).withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), at).otherwise(1).cast("int")).groupBy(key, "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("points"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return every.join(means, [key, "bin"], "left").select(key, "bin", (F.col("_lo") + (F.col("bin") - 0.5) * (F.col("_hi") - F.col("_lo")) / n).alias("center"), "mean", F.coalesce("points", F.lit(0)).alias("points"))


def bin_means(binned: DataFrame, key: str) -> DataFrame:
    """(key, vec): means by bin as they are; null where a bin is empty."""
    v = binned.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "mean"))), lambda x: x["mean"]).alias("vec"))
    return v.withColumn("vec", F.when(F.forall("vec", lambda x: x.isNotNull()), F.col("vec")))


def bin_vector(binned: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """(key, vec, is_valid): means by bin, padded or cut, z-scored over the vector; not valid where a bin is empty or all are equal."""
    v = binned.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "mean"))), lambda x: x["mean"]).alias("v"))
    if size:
        v = v.withColumn("v", X.pad_or_cut("v", size))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    v = v.withColumn("_m", mean).withColumn("_s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / F.size("v")))
    ok = F.col("_s").isNotNull() & (F.col("_s") > 0)
    return v.select(key, F.when(ok, F.transform("v", lambda x: (x - F.col("_m")) / F.col("_s"))).alias("vec"), ok.alias("is_valid"))


def shape(binned: DataFrame, key: str) -> DataFrame:
    """Depth, width, baseline deviation and asymmetry of folded, binned series without empty bins."""
    ok = binned.groupBy(key).agg(F.min("mean").alias("low"), F.median("mean").alias("mid"), F.percentile("mean", F.lit(0.8)).alias("p80"), F.count_if(F.col("mean").isNull()).alias("empty"), F.max("bin").alias("nb"))
    rows = binned.join(ok.filter("empty = 0"), key)
    half = F.col("mean") < (F.col("mid") + F.col("low")) / 2
    first = rows.groupBy(key).agg(
        F.max(F.col("low") - F.col("mid")).alias("depth"),
        F.when(F.count_if(half) >= 2, F.max(F.when(half, F.col("center"))) - F.min(F.when(half, F.col("center")))).otherwise(F.lit(0.0)).alias("width"),
        F.stddev_pop(F.when(F.col("mean") > F.col("p80"), F.col("mean"))).alias("baseline_std"),
    )
    pairs = rows.withColumn("j", F.least("bin", F.col("nb") + 1 - F.col("bin"))).filter("bin <> nb + 1 - bin").groupBy(key, "j").agg((F.max("mean") - F.min("mean")).alias("d"))
    return first.join(pairs.groupBy(key).agg(F.avg("d").alias("asymmetry")), key)


def autocorrelation(binned: DataFrame, key: str, value: str = "mean") -> DataFrame:
    """(key, lag, ac): sums of products of z-scored values ``lag`` bins apart, lag 1 set to zero. Equal values have z-scores of 0."""
    own = Window.partitionBy(key)  # a fixed number of bins
    apart, spread = F.col(value) - F.avg(value).over(own), F.stddev_pop(value).over(own)
    z = binned.withColumn("_z", F.when(F.col(value).isNotNull(), F.when(spread > 0, apart / spread).otherwise(F.lit(0.0))))
    a, b = z.select(key, F.col("bin").alias("i"), F.col("_z").alias("x")), z.select(key, F.col("bin").alias("j"), F.col("_z").alias("y"))
    pairs = a.join(b, key).filter("j > i")  # within one series of a fixed number of bins
    return pairs.withColumn("lag", F.col("j") - F.col("i")).groupBy(key, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("ac")).withColumn("ac", F.when(F.col("lag") == 1, F.lit(0.0)).otherwise(F.col("ac")))


def autocorrelation_peak(ac: DataFrame, key: str) -> DataFrame:
    """The value at the first lag that is above both neighbours, or 0."""
    w = Window.partitionBy(key).orderBy("lag")
    peaks = ac.withColumn("_p", F.lag("ac").over(w)).withColumn("_n", F.lead("ac").over(w))
    hit = (F.col("ac") > F.col("_p")) & (F.col("ac") > F.col("_n"))
    return peaks.groupBy(key).agg(F.coalesce(F.min_by(F.when(hit, F.col("ac")), F.when(hit, F.col("lag"))), F.lit(0.0)).alias("autocorr_strength"))


def phase_fold(
    series: DataFrame, key: str, low_period: float = 0.2, high_period: float = 20.0, samples: int = 10, threshold: float = 0.05, least_period: float | None = None, most_period: float | None = None,
    n: int = 100, shift: float = 0.0, least: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """(points, bins) of each series at the period that a search of its regular grid finds.

    points: (key, t, phase, z, best_period, peak_power); bins: (key, bin, center, mean, points), n a series. Series with
    fewer than ``least`` finite points, a peak below ``threshold``, or a period outside of the inclusive gates drop out.
    """
    rows = zscore(series, key, least=least)
    z = rows.select(key, "t", F.col("z").alias("flux"))
    found = best_period(spectra.power(z, key, spectra.grids(z, key, low_period, high_period, samples)), key, threshold)
    gate = F.col("best_period").between(least_period or low_period, most_period or high_period)
    found = cut(found.filter(gate))  # one row a series, searched for once
    points = rows.join(found, key).select(key, "t", X.phase("t", F.col("best_period"), shift).alias("phase"), "z", "best_period", "peak_power")
    return points, bins(points, key, n)


def centroid_shift(rows: DataFrame, key: str, center: float = 0.75, half: float = 0.05, corr: float = 0.3, limit: float = 0.005) -> DataFrame:
    """Multi-source test from (key, phase, flux, mom_x, mom_y, pos_x, pos_y): do the moments move when the flux dips?

    The correlation with the positions is told, but does not decide. A depth below 0.0001, a negative one too, counts as that.
    """
    inside = F.abs(F.col("phase") - center) < half
    outside = F.abs(F.col("phase") - center) > 2 * half
    move = lambda c: F.avg(F.when(inside, F.col(c))) - F.avg(F.when(outside, F.col(c)))
    dip = F.median(F.when(outside, F.col("flux"))) - F.median(F.when(inside, F.col("flux")))
    m = rows.groupBy(key).agg(
        F.corr("flux", "pos_x").alias("corr_x"),
        F.corr("flux", "pos_y").alias("corr_y"),
        move("mom_x").alias("delta_x"),
        move("mom_y").alias("delta_y"),
        F.when(dip.isNotNull(), F.greatest(dip, F.lit(1e-4))).alias("depth"),
    )
    m = m.withColumn("local_shift", F.greatest(F.abs("delta_x"), F.abs("delta_y"))).withColumn("effective_shift", F.col("local_shift") / F.col("depth"))
    return m.withColumn("multi_source", F.col("effective_shift") > limit / 0.01).withColumn("correlated", F.greatest(F.abs("corr_x"), F.abs("corr_y")) > corr)


def centroid_test(curves: DataFrame, periods: DataFrame, key: str = "filename", shift: float = 0.0, **limits) -> DataFrame:
    """centroid_shift of light curves (key, t, flux, mom_x, mom_y, pos_x, pos_y), each folded by its row of periods (key, best_period).

    Points that lack any of the six numbers take no part; curves without a period, or with one that is null or not above 0, are left out.
    """
    whole = curves.dropna(subset=["t", "flux", "mom_x", "mom_y", "pos_x", "pos_y"])
    rows = whole.join(periods.filter("best_period > 0").select(key, "best_period"), key)
    return centroid_shift(rows.withColumn("phase", X.phase("t", F.col("best_period"), shift)), key, **limits)
