"""Connected components of a distributed edge list, and rows kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lightloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, for loops.

    A checkpoint keeps the estimated size of its plan, which joins multiply: after some rounds, the planner spends its time
    on numbers of millions of digits. A table has the size of its files.
    """
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A key with more than LEAST rows, and more than a HOT-th of all rows, is dealt to several tasks: at most HOT keys are.
LEAST, HOT = 1000, 50_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], total: int, top: int, size: str = "n") -> DataFrame:
    """Inner join of ``left``, of about ``total`` rows, with ``right``: one row a key, in ``size`` the left rows that have it.

    Keys with many rows are split by the hash of ``spread``, and their row of ``right`` is repeated for each part; only
    their names, HOT at most, are broadcast. ``top``, the largest size, tells whether there are any.
    """
    most = max(LEAST, total // HOT)
    if top <= most:
        return left.join(right, on)
    parts = F.ceil(F.col(size) / most)
    hot = right.filter(parts > 1).select(*on, parts.alias("_parts"))
    part = F.when(F.col("_parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")))
    marked = left.join(F.broadcast(hot), on, "left").withColumn("_part", part).drop("_parts")
    dealt = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return marked.join(dealt, [*on, "_part"]).drop("_part")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each keeps the components and brings every
    node nearer to its root; the number of rounds grows with the logarithm of the longest path. A round is two
    groupings by node with a minimum, which are summed up before the shuffle, and joins in which the edges of a hub are
    dealt to several tasks; edges never reach the driver, only their number and a checksum, by which it sees that a
    round has changed nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())

    def look(edges: DataFrame) -> tuple:
        """Edges, the most that a node has to smaller or from larger ones, and a checksum."""
        ends = edges.select("u", F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).cast("decimal(38,0)").alias("h")))
        by = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
        return tuple(by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.sum("h")).first())

    before = look(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # large star: the larger neighbours of a node go to the smallest of its neighbours and itself
        large = join_hot(both, low, ["u"], ["v"], *before[:2]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.filter("u > v").distinct()
        if before[1] > LEAST:  # a plan that splits hubs is long enough without being repeated below
            large = cut(large)
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, ["u"], ["v"], *before[:2]).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = look(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point within {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
