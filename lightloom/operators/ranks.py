"""Places in a total order, and exact quantiles, without a window or a buffer that holds a whole table or group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import cut, settled


def beside(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``groups``: one row a value of ``by`` (null is one too), or a single row without ``by``."""
    if not by:
        return df.join(F.broadcast(groups))
    named = groups.withColumnsRenamed({c: f"_{c}" for c in by})
    return df.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])).drop(*[f"_{c}" for c in by])


def numbered(df: DataFrame, order: list[Column], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Adds rn, the place in ``order`` from 1 within ``by``, and n, the group's size; with a weight, running and total sums of it.

    Rows are sorted over range partitions, so a group of any size is dealt to several tasks; the rows ahead of a
    partition come from one number a partition. ``order`` should tell rows apart: equal ones share a partition.
    """
    by = list(by)
    sorted_ = df.orderBy(*[F.col(c) for c in by], *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(sorted_).withColumn("_p", F.shiftright("_at", 33))  # the partition, then the row in it
    sizes = placed.groupBy("_p").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))  # one row a partition
    within = F.sum(weight).over(Window.partitionBy("_p").orderBy("_at")) if weight else F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = placed.withColumn("_within", within).join(F.broadcast(starts), "_p").withColumn("rn", F.col("_start") + F.col("_within")).drop("_at", "_p", "_start", "_within")
    first = F.min(F.col("rn") - (F.col(weight) if weight else F.lit(1))).alias("_first")
    groups = rows.groupBy(*by).agg(first, (F.sum(weight) if weight else F.count("*")).alias("n"))
    return beside(rows, groups, by).withColumn("rn", F.col("rn") - F.col("_first")).drop("_first")


#: A sketch tells quantiles to one part in ACCURACY of the rows; what lies between two of its marks is then looked at itself,
#: by value: BOUND different values at most by a window, more by a sort. Beyond MARKS quantiles at once, one sort is cheaper.
ACCURACY, BOUND, MARKS = 2000, 1_000_000, 8


def quantiles(df: DataFrame, column: str, at: list[float], by: list[str] = ()) -> DataFrame:
    """(by, i, threshold): the exact quantile ``at[i]`` of the column's values, between neighbours by linear interpolation.

    A sketch a group brackets each quantile; one pass counts the values below a bracket and takes out those within it, a few
    thousandths of all; the place of the quantile among these is its place among all less the values below. Nothing is
    sorted but the brackets. Where a sketch has missed a place, all values are sorted instead. Nulls take no part; a group of
    nulls alone, or an empty table, gives no rows.
    """
    by = list(by)
    rows = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).alias("_x"))
    if len(at) > MARKS:
        return _by_sort(rows, at, by)
    told = lambda shift: F.percentile_approx("_x", [min(1.0, max(0.0, q + shift)) for q in at], ACCURACY)
    ends = settled(rows.groupBy(*by).agg(F.count("*").alias("n"), told(-2 / ACCURACY).alias("lo"), told(2 / ACCURACY).alias("hi")))
    near = beside(rows, ends, by)
    brackets = F.transform(F.arrays_zip("lo", "hi"), lambda m, i: F.struct(i.alias("i"), m["lo"].alias("a"), m["hi"].alias("b")))
    inside = near.select(*by, "_x", F.inline(F.filter(brackets, lambda m: F.col("_x").between(m["a"], m["b"]))))
    inside = settled(inside.groupBy(*by, "i", "_x").agg(F.count("*").alias("_w")))
    under = near.groupBy(*by).agg(F.array(*[F.count_if(F.col("_x") < F.col("lo")[i]) for i in range(len(at))]).alias("_u"), F.first("n").alias("_all"))
    under = under.select(*by, "_all", F.posexplode("_u").alias("i", "_under"))
    if inside.count() <= BOUND:
        own = Window.partitionBy(*by, "i").orderBy("_x")
        placed = inside.withColumn("rn", F.sum("_w").over(own))
    else:
        placed = numbered(inside, [F.col("_x")], [*by, "i"], "_w").drop("n")
    placed = beside(placed, under, [*by, "i"]).withColumn("rn", F.col("rn") + F.col("_under"))
    p = F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("i") + 1) * (F.col("_all") - 1)
    # a value stands at the 0-based places from rn - _w to rn - 1; the quantile lies between two places, or at one
    placed = placed.withColumn("p", p).filter((F.ceil("p") >= F.col("rn") - F.col("_w")) & (F.floor("p") < F.col("rn")))
    full = (F.min(F.col("rn") - F.col("_w")) <= F.min(F.floor("p"))) & (F.max("rn") > F.max(F.ceil("p")))
    found = settled(placed.groupBy(*by, "i").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.max(F.col("p") - F.floor("p")).alias("part"), full.alias("full")))
    if found.filter("full").count() < ends.count() * len(at):
        return _by_sort(rows, at, by)
    return found.select(*by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("threshold"))


def medians(df: DataFrame, column: str, by: list[str], name: str = "median") -> DataFrame:
    """(by, name): exact medians of groups of any size."""
    return quantiles(df, column, [0.5], by).select(*by, F.col("threshold").alias(name))


def _by_sort(rows: DataFrame, at: list[float], by: list[str]) -> DataFrame:
    """The same by sorting all different values (by, _x) over range partitions."""
    counts = rows.groupBy(*by, "_x").agg(F.count("*").alias("_w"))
    rows = numbered(counts, [F.col("_x")], by, "_w")
    marks = F.transform(F.array(*[F.lit(float(q)) for q in at]), lambda q, i: F.struct(i.alias("i"), (q * (F.col("n") - 1)).alias("p")))
    here = F.filter(marks, lambda m: (F.ceil(m["p"]) >= F.col("rn") - F.col("_w")) & (F.floor(m["p"]) < F.col("rn")))
    found = rows.select(*by, "_x", F.inline(here)).groupBy(*by, "i").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.max(F.col("p") - F.floor("p")).alias("part"))
    return found.select(*by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("threshold"))
