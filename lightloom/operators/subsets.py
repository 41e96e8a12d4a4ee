"""Which columns separate two groups best: exact silhouettes of every subset of columns, in one job."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import settled
from . import ranks
from .blocks import far, pairwise

#: More subsets than this are refused: 2 ** columns grows beyond use.
MOST_SUBSETS = 4096

#: Distances that a task holds at a time, and bytes of a block.
STRIP, BLOCK_BYTES = 1 << 20, 1 << 26


def subsets_of(columns: list[str], least: int = 2) -> list[tuple[str, ...]]:
    return [c for r in range(least, len(columns) + 1) for c in combinations(columns, r)]


def silhouettes(rows: DataFrame, columns: list[str], label: Column, key: str = "id", least: int = 2, block: int = 2048) -> DataFrame:
    """(features, silhouette, n): one row a subset of at least ``least`` columns, for the labelling ``label``.

    Rows with a null column or label take no part. Columns are compared as they are: scale them before. An exact
    silhouette needs every distance, so the work grows with the square of the rows, each pair once; it is spread as pairs of
    blocks of at least ``block`` rows, as many blocks as give each task a pair or so, so that what moves grows with the
    blocks. Rows stand in the order of their labels: of a label that lies within one block only the least mean moves on,
    of the others (two a block) sums. Points alone in their group count 0; a single group gives 0.
    """
    chosen = subsets_of(columns, least)
    if not chosen or len(chosen) > MOST_SUBSETS:
        raise ValueError(f"{len(chosen)} subsets of {len(columns)} columns")
    spark, d = rows.sparkSession, len(columns)
    base = rows.select(F.col(key).alias("id"), label.cast("string").alias("label"), F.expr(f"array({', '.join(f'cast(`{c}` as double)' for c in columns)})").alias("v")).dropna()
    base = settled(ranks.numbered(base.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x))), [F.col("label"), F.xxhash64("id"), F.col("id")]).drop("n"))
    n, tasks = base.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(block, -(-n // max(2, int(np.ceil(np.sqrt(tasks))))))
    size = max(1, min(size, max(block, BLOCK_BYTES // (8 * d))))
    groups = base.groupBy("label").agg(F.min("rn").alias("start"), F.count("*").alias("m"))
    placed = ranks.beside(base, groups, ["label"]).withColumn("block", F.floor((F.col("rn") - 1) / size).cast("long"))
    packed = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rn", "start", "m", "v"))).alias("r"))
    packed = settled(packed.select("block", F.col("r.start").alias("start"), F.col("r.m").alias("m"), F.flatten("r.v").alias("flat")))
    masks = [np.array([c in s for c in columns]) for s in chosen]

    def strips(x, y):
        """(from, to, distances of each subset) for some rows of x at a time."""
        wide = len(masks) == 1 and d > 8
        few, columns_of = max(1, (STRIP if wide else STRIP >> 3) // len(y)), np.ascontiguousarray(y.T)
        for a in range(0, len(x), few):
            at = slice(a, min(a + few, len(x)))
            if wide:
                yield at, [far(x[at], y)]
                continue
            square = [np.square(x[at, j : j + 1] - columns_of[j]) for j in range(d)]
            yield at, (np.sqrt(sum(q for q, m in zip(square, mask) if m)) for mask in masks)

    class Groups:
        """The labels of a block: where each starts, and which go on in other blocks."""

        def __init__(self, r):
            self.start, self.m = np.asarray(r.start), np.asarray(r.m)
            self.codes, self.at = np.unique(self.start, return_index=True)
            self.sizes = self.m[self.at]
            self.cut = (self.codes - 1) // size != (self.codes + self.sizes - 2) // size
            self.x = np.asarray(r.flat).reshape(len(self.m), d)

    def told(of, s, against, sums, low, own=None, this=None):
        return {
            "block": of, "s": s, "codes": against.codes[against.cut], "sizes": against.sizes[against.cut], "sums": sums.tobytes(), "low": low.tobytes(),
            "own": None if own is None else own.tobytes(), "start": None if this is None else this.start.tobytes(), "m": None if this is None else this.m.tobytes(),
        }

    def compared(x, y, left, right):
        """What the rows of each block are told by the labels of the other one."""
        a, b = Groups(left), Groups(right)
        sums = [[np.zeros((g.cut.sum(), len(o.m))) for _ in masks] for g, o in ((b, a), (a, b))]
        low = [[np.full(len(g.m), np.inf) for _ in masks] for g in (a, b)]
        own = [np.zeros(len(a.m)) for _ in masks]
        rest: list = [None] * len(masks)  # sums of a label of x that goes on in the next strip
        mine = np.searchsorted(b.codes, a.start) if x == y else None
        for at, tables in strips(a.x, b.x):
            first, last = np.searchsorted(a.codes, (a.start[at][0], a.start[at][-1]))
            begin = np.maximum(a.at[first : last + 1] - at.start, 0)
            for s, table in enumerate(tables):
                by = np.add.reduceat(table, b.at, axis=1)
                sums[0][s][:, at] = by[:, b.cut].T
                mean = np.where(b.cut, np.inf, by / b.sizes)
                if x == y:
                    row = np.arange(len(by))
                    own[s][at] = np.where(b.cut[mine[at]], 0.0, by[row, mine[at]])
                    mean[row, mine[at]] = np.inf
                low[0][s][at] = mean.min(1)
                if x != y:
                    by = np.add.reduceat(table, begin, axis=0)
                    if rest[s] is not None and rest[s][0] == first:
                        by[0] += rest[s][1]
                    done = np.arange(first, last + 1)
                    ended = at.stop == len(a.m) or a.start[at.stop] != a.start[at.stop - 1]
                    rest[s] = None if ended else (last, by[-1])
                    by, done = (by, done) if ended else (by[:-1], done[:-1])
                    cut_ = a.cut[done]
                    sums[1][s][np.cumsum(a.cut)[done[cut_]] - 1] = by[cut_]
                    if not cut_.all():
                        low[1][s] = np.minimum(low[1][s], (by[~cut_] / a.sizes[done[~cut_], None]).min(0))
        for s in range(len(masks)):
            yield told(x, s, b, sums[0][s], low[0][s], own[s] if x == y else None, a if x == y else None)
            if x != y:
                yield told(y, s, a, sums[1][s], low[1][s])

    def run(batches):
        before = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.x == r.y:
                    yield pd.DataFrame(compared(r.x, r.y, r, r))
                elif before is None:
                    before = r
                else:
                    yield pd.DataFrame(compared(r.x, r.y, before, r))
                    before = None

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s, part in pdf.groupby("s"):
            head = part[part["start"].notna()].iloc[0]
            start, m, near = (np.frombuffer(head[c], dtype=t) for c, t in (("start", np.int64), ("m", np.int64), ("own", float)))
            low, near = np.min([np.frombuffer(v, dtype=float) for v in part["low"]], axis=0), near.copy()
            parts: dict = {}
            for codes, sizes, sums in zip(part["codes"], part["sizes"], part["sums"]):
                for code, count, v in zip(codes, sizes, np.frombuffer(sums, dtype=float).reshape(len(codes), len(m))):
                    parts[code] = (count, parts[code][1] + v if code in parts else v)
            for code, (count, v) in parts.items():
                own = start == code
                near[own] = v[own]
                low = np.where(own, low, np.minimum(low, v / count))
            near = near / np.maximum(m - 1, 1)
            top = np.maximum(near, low)
            good = (m > 1) & np.isfinite(low) & (top > 0)
            out.append((s, float(((low - near)[good] / top[good]).sum()), len(m)))
        return pd.DataFrame(out, columns=["s", "total", "n"])

    schema = "block long, s int, codes array<long>, sizes array<long>, sums binary, low binary, own binary, start binary, m binary"
    pairs = pairwise(packed, -(-n // size) or 1, tasks).select("x", "y", "block", "start", "m", "flat")
    found = settled(pairs.mapInPandas(run, schema)).groupBy("block").applyInPandas(summed, "s int, total double, n long")
    named = spark.createDataFrame([(i, ",".join(s)) for i, s in enumerate(chosen)], "s int, features string")
    each = found.groupBy("s").agg((F.sum("total") / F.sum("n")).alias("silhouette"), F.sum("n").alias("n"))
    return each.join(F.broadcast(named), "s").select("features", "silhouette", "n")
