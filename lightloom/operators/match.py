"""Nearest labelled vector by cosine, thresholds, label groups; feature vectors from series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..components import settled
from ..functions import exprs as X
from . import ranks
from .blocks import block_pairs, by_pivots, meet


#: With more pairs of blocks than these, blocks are made of near vectors, and pairs that can't hold a winner are left out.
PAIRS = 64

#: Blocks of a tile in each direction, at most: what moves for pairs of blocks grows with their number over this.
TILE = 16


def cosine_top1(objects: DataFrame, labelled: DataFrame, key: str = "filename", vec: str = "vec", label: str = "label", digits: int | None = None, similarity=None, block: int = 2048) -> DataFrame:
    """(key, matched, matched_label, similarity): the most similar labelled vector, ties to the smaller name.

    similarity: (m x d array, n x d array) -> m x n array, the cosine by default, 0 where a vector is zero or null. Objects
    whose vectors have another length than the labelled ones (the commonest of these), or components that are no finite
    numbers, have null matches; such labelled vectors take no part. The cosine is searched in pairs of blocks that their
    centres and radii leave (see ``nearest_by_angle``), other measures in all pairs of blocks; of each pair of blocks one row
    an object moves on.
    """
    measure = similarity or cosines
    sizes = labelled.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    size = sizes["n"] if sizes else 0
    whole = F.coalesce(F.col(vec).cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    fits = (F.size(whole) == size) & F.forall(whole, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    left, right = objects.filter(fits).select(F.col(key).alias("k"), whole.alias("v")), labelled.filter(fits).select(F.col(key).alias("k"), whole.alias("v"), F.col(label).alias("label"))
    many = similarity is None and -(-left.count() // block) * -(-right.count() // block) > PAIRS
    if many:
        best = nearest_by_angle(left, right, digits, block)[0]
    else:
        best = _all_pairs(left, right, measure, digits, block)
    out = best.select(F.col("key").alias(key), "matched", "matched_label", "similarity")
    none = objects.filter(~fits).select(key, *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[1:]])
    return out.unionByName(none)


def _all_pairs(left: DataFrame, right: DataFrame, measure, digits: int | None, block: int) -> DataFrame:
    kinds = {n: df.schema[c].dataType.simpleString() for n, df, c in (("key", left, "k"), ("matched", right, "k"), ("matched_label", right, "label"))}

    def run(batches):
        for pdf in batches:
            for ids, x, names, y, labels in zip(pdf["left_k"], pdf["left_v"], pdf["right_k"], pdf["right_v"], pdf["right_label"]):
                found = measure(np.array([list(v) for v in x], dtype=float), np.array([list(v) for v in y], dtype=float))
                found = np.round(found, digits) if digits else found
                best = found.argmax(1)  # the first of equals, and names stand in order
                yield pd.DataFrame({"key": list(ids), "matched": [names[j] for j in best], "matched_label": [labels[j] for j in best], "similarity": found[np.arange(len(best)), best]})

    near = meet(left, right, block).mapInPandas(run, ", ".join(f"{n} {kind}" for n, kind in kinds.items()) + ", similarity double")
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "matched", "matched_label", "similarity")).alias("b"))
    return best.select("key", "b.matched", "b.matched_label", "b.similarity")


def nearest_by_angle(left: DataFrame, right: DataFrame, digits: int | None = None, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """((key, matched, matched_label, similarity), (x, y, met)) of (k, v) and (k, v, label), vectors of one length.

    Vectors are scaled to length one (zero ones stay), where the cosine is 1 - d * d / 2 of the distance d, and lie in
    blocks around pivots. Each block of objects first meets the labelled block that may be nearest; how similar its least
    similar match is there then tells which other blocks could hold a better one. (x, y, met): the pairs of blocks, and
    whether they met.
    """
    def numbered(df):
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        rows = ranks.numbered(df, [F.col("k")]).withColumn("_l", length)
        return settled(rows.select(F.col("rn").alias("i"), "k", F.when(F.col("_l") > 0, F.transform("v", lambda x: x / F.col("_l"))).otherwise(F.col("v")).alias("vec"), *[c for c in df.columns if c == "label"]))

    a, b = numbered(left), numbered(right)
    one, two = by_pivots(a, block=block), by_pivots(b, block=block)
    pairs = block_pairs(one, two)
    slack = 0.5 * 10.0**-digits * 2 if digits else 0.0
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, min(TILE, int(np.sqrt(4 * pairs.count() / tasks))))  # smaller ones, where tasks would have none

    def met(chosen: DataFrame) -> DataFrame:
        """(x, i, j, s): the best of each row within the chosen pairs of a tile of some blocks by as many others, each of which moves once a tile."""

        def run(batches):
            tile, mine, best = None, {}, {}

            def told():
                for x, (s, j) in best.items():
                    yield pd.DataFrame({"x": x, "i": mine[x][0], "j": j, "s": s})

            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    if tile != (r.gx, r.gy):
                        yield from told()
                        tile, mine, best = (r.gx, r.gy), {}, {}
                    ids, v = np.asarray(r.ids), np.asarray(r.flat).reshape(len(r.ids), -1)
                    if r.xs is None:
                        mine[r.block] = ids, v
                        continue
                    for x in r.xs:
                        found = cosines(mine[x][1], v)
                        found = np.round(found, digits) if digits else found
                        at = found.argmax(1)  # ids follow the names
                        s, j = found[np.arange(len(at)), at], ids[at]
                        if x in best:
                            better = (s > best[x][0]) | ((s == best[x][0]) & (j < best[x][1]))
                            s, j = np.where(better, s, best[x][0]), np.where(better, j, best[x][1])
                        best[x] = s, j
            yield from told()

        dealt = chosen.select("x", "y", F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy"))
        blocks = [df.select(F.col("block").alias(c), "ids", "flat") for df, c in ((one, "x"), (two, "y"))]
        u = dealt.select("gx", "gy", "x").distinct().join(blocks[0], "x").select("gx", "gy", F.col("x").alias("block"), F.lit(None).cast("array<long>").alias("xs"), "ids", "flat")
        v = dealt.groupBy("gx", "gy", "y").agg(F.collect_list(F.col("x").cast("long")).alias("xs")).join(blocks[1], "y").select("gx", "gy", F.col("y").alias("block"), "xs", "ids", "flat")
        rows = u.unionByName(v).repartition(tasks, "gx", "gy").sortWithinPartitions("gx", "gy", F.col("xs").isNotNull(), "block")
        return settled(rows.mapInPandas(run, "x long, i long, j long, s double"))

    first = pairs.groupBy("x").agg(F.min_by("y", F.struct("least", "y")).alias("y"))
    start = met(first)
    # a labelled vector at distance d has a cosine of 1 - d * d / 2 with a unit vector; zero vectors have 0 with all
    reach = start.groupBy("x").agg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.min("s") - slack))).alias("reach")).withColumn("reach", F.col("reach") * (1 + 1e-9) + 1e-9)
    marked = pairs.join(first.withColumnRenamed("y", "_first"), "x").join(reach, "x").withColumn("_near", (F.col("least") <= F.col("reach")) | (F.col("reach") >= 1.0))
    marked = settled(marked.select("x", "y", (F.col("y") == F.col("_first")).alias("_done"), (F.col("_near") | (F.col("y") == F.col("_first"))).alias("met")))
    rest = met(marked.filter("met and not _done"))
    best = start.unionByName(rest).groupBy("i").agg(F.min(F.struct((-F.col("s")).alias("n"), "j", "s")).alias("b")).select("i", "b.j", F.col("b.s").alias("similarity"))
    out = best.join(a.select("i", F.col("k").alias("key")), "i").join(b.select(F.col("i").alias("j"), F.col("k").alias("matched"), F.col("label").alias("matched_label")), "j")
    return out.select("key", "matched", "matched_label", "similarity"), marked.select("x", "y", "met")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
    return np.divide(x @ y.T, n, out=np.zeros(n.shape), where=n > 0)


def thresholded(matches: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Below the threshold the label is outlier; adds label_group."""
    label = F.when(F.col("similarity") < threshold, F.lit("outlier")).otherwise(F.col("matched_label"))
    return matches.withColumn("matched_label", label).withColumn("label_group", X.label_group("matched_label"))


def packed(series: DataFrame, key: str) -> DataFrame:
    """(key, t, flux): arrays by time, of finite points."""
    rows = series.filter(X.finite("t", "flux")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "flux"))).alias("p"))
    return rows.select(key, F.col("p.t").alias("t"), F.col("p.flux").alias("flux"))


def gls(t: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Floating-mean power at the frequencies f, NaN where it is not defined."""
    out = np.empty(len(f))
    y = y - y.mean()
    yy = (y * y).mean()
    n = len(t)
    for i in range(0, len(f), 256):
        sums = 0.0
        for k in range(0, n, 2048):  # frequencies by points at a time
            a, v = 2 * np.pi * f[i : i + 256, None] * t[k : k + 2048], y[k : k + 2048]
            c, s = np.cos(a), np.sin(a)
            sums = sums + np.stack([c.sum(1), s.sum(1), c @ v, s @ v, (c * c).sum(1), (s * s).sum(1), (c * s).sum(1)])
        cm, sm, yc, ys, cc, ss, cs = sums / n
        cc, ss, cs = cc - cm * cm, ss - sm * sm, cs - cm * sm
        d = cc * ss - cs * cs
        with np.errstate(divide="ignore", invalid="ignore"):
            out[i : i + 256] = np.where((yy > 1e-300) & (np.abs(d) > 1e-300), (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * d), np.nan)
    return out


def flux_power_stack(series: DataFrame, key: str, points: int = 3000, freqs: int = 1000, low: float = 1 / 27, high: float = 6.0) -> DataFrame:
    """(key, vec): z-scored flux cut or padded to ``points``, then the power at ``freqs`` log-spaced frequencies."""
    grid = np.logspace(np.log10(low), np.log10(high), freqs)

    def one(a, b):
        a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
        z = (b - b.mean()) / b.std() if len(b) and b.std() > 0 else np.zeros(len(b))
        head = np.zeros(points)
        head[: min(points, len(z))] = z[:points]
        return np.concatenate([head, gls(a, z, grid) if len(z) else np.zeros(freqs)])

    def stack(batches):
        few = max(1, (1 << 20) // (points + freqs))  # vectors that a task holds before it hands them on, some 8 MB
        for pdf in batches:
            for at in range(0, len(pdf), few):
                part = pdf.iloc[at : at + few]
                yield pd.DataFrame({key: part[key], "vec": [one(a, b) for a, b in zip(part["t"], part["flux"])]})

    packs = packed(series, key)
    return packs.mapInPandas(stack, f"{key} {packs.schema[key].dataType.simpleString()}, vec array<double>")


def match_series(series: DataFrame, labelled: DataFrame, key: str = "filename", compute=flux_power_stack, model=None, size: int | None = None, threshold: float = 0.6) -> DataFrame:
    """(key, matched, matched_label, similarity, label_group): series against labelled vectors (key, vec, label).

    compute: (series, key) -> (key, vec), the flux and power stack by default. Its vectors are projected by ``model``
    (of cluster.fit_projection) or, without one, padded or cut to ``size``, if given. Below the threshold the label is outlier.
    """
    objects = compute(series, key)
    if model is not None:
        objects = model.apply(objects).select(key, F.col("scores").alias("vec"))
    elif size:
        objects = objects.select(key, X.pad_or_cut("vec", size).alias("vec"))
    return thresholded(cosine_top1(objects, labelled, key), threshold)
