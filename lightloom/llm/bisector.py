"""Centroid clustering in whole numbers, by a tournament of bisecting planes.

A point x is nearer to centroid b than to a where 2 * (b - a) * x > |b|^2 - |a|^2. The normals 2 * (b - a) and thresholds
|b|^2 - |a|^2 of all pairs are computed once a round. A point then takes k - 1 sign tests: the winner so far meets the next
centroid, and loses where the test is above zero, so at zero the smaller number stays. Only the distance to the winner is
ever computed. All of it is exact: in 64-bit integers where no sum can leave them, in Python's otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Components up to here keep 64-bit tests and distances exact: 64 products of 2**27 and 2**29 stay below 2**63.
SAFE = 1 << 27
#: Sums travel in digits of this many bits, so that they can be of any size.
LIMB = 40
#: Points that a task compares at once.
ROWS = 4096


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, scale a power of two: int64 where that is safe, else Python integers."""
    scaled = np.floor(x * float(scale))
    if not len(x) or np.abs(scaled).max() <= SAFE:
        return scaled.astype(np.int64)
    return np.array([[int(v) * scale if abs(v) > 2.0**53 else int(v * scale // 1) for v in row] for row in x.tolist()], dtype=object)


class Tournament:
    """Normals [a, b, component] and thresholds [a, b] of all pairs of centroids (lists of integers)."""

    def __init__(self, centroids: list[list[int]]):
        safe = all(abs(v) <= SAFE for c in centroids for v in c) and all(len(c) <= 64 for c in centroids)
        self.centroids = np.array(centroids, dtype=np.int64 if safe else object)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        square = (self.centroids * self.centroids).sum(axis=1)
        self.thresholds = square[None, :] - square[:, None]

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance to it) of each row."""
        best = np.zeros(len(x), dtype=np.int64)
        exact = object if object in (x.dtype, self.centroids.dtype) else np.int64
        x = x.astype(exact)
        for b in range(1, len(self.centroids)):
            test = (x * self.normals[best, b]).sum(axis=1) - self.thresholds[best, b]
            best[test > 0] = b
        apart = x - self.centroids[best]
        return best, (apart * apart).sum(axis=1)


def limbs(value: int) -> list[int]:
    """Digits of LIMB bits, lowest first; the last one carries the sign."""
    out = []
    while abs(value) >= 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def sums(points: DataFrame, tournament: Tournament, dim: int, scale: int) -> dict:
    """{(cluster, component): sum}, component -1 the number of points; tasks add up their own rows first."""
    shared = points.sparkSession.sparkContext.broadcast(tournament)

    def run(batches):
        k = len(shared.value.centroids)
        total = np.zeros((k, dim + 1), dtype=object)
        for x in blocks(batches, dim, scale):
            best, _ = shared.value.winners(x)
            for c in np.unique(best).tolist():
                own = x[best == c]
                total[c, :dim] += np.array(own.sum(axis=0).tolist(), dtype=object)
                total[c, dim] += len(own)
        rows = [(c, j, i, v) for c in range(k) if total[c, dim] for j in range(dim + 1) for i, v in enumerate(limbs(int(total[c, j])))]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cluster", "component", "limb", "value"])

    found: dict = {}
    per = points.select("vec").mapInArrow(run, "cluster long, component long, limb long, value long").groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value"))
    for r in per.collect():  # k * (dim + 1) sums of a few digits
        at = (r["cluster"], -1 if r["component"] == dim else r["component"])
        found[at] = found.get(at, 0) + (r["value"] << (LIMB * r["limb"]))
    return found


def blocks(batches, dim: int, scale: int):
    for batch in batches:
        x = np.asarray(batch.column("vec").flatten(), dtype=np.float64).reshape(-1, dim)
        for a in range(0, len(x), ROWS):
            yield whole(x[a : a + ROWS], scale)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance), centroids): each vector's nearest of k centroids after so many rounds.

    Vectors with exactly ``dim`` components, none null or not finite, take part, each component as floor(scale * x). The
    first centroids are those with the smallest SHA-256 of salt and key, in that order (equal keys by their vectors, null
    keys last); fewer vectors than k are fewer centroids. A round assigns all vectors (ties: smaller number) and moves each
    centroid to the floor of its vectors' mean; one without vectors stays. Repeated rows count as often as they
    stand there. A distance beyond a long is null. No vectors give no rows and no centroids. Other columns are not read.
    """
    v = F.col("vec")
    rows = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("vec")).filter(F.size(v) == dim)
    rows = cut(rows.filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))))
    named = rows.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256))
    first = named.orderBy(F.col("_h").asc_nulls_last(), F.col(key), "vec").limit(k).select("vec").collect()  # k rows
    centroids = [whole(np.array([r["vec"]]), scale)[0].tolist() for r in first]
    for _ in range(rounds if centroids else 0):
        total = sums(rows, Tournament(centroids), dim, scale)
        centroids = [[total[c, j] // total[c, -1] for j in range(dim)] if (c, -1) in total else old for c, old in enumerate(centroids)]
    shared = vectors.sparkSession.sparkContext.broadcast(Tournament(centroids) if centroids else None)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near, far = [], []
            for x in blocks([batch], dim, scale):
                best, distance = shared.value.winners(x)
                near.append(best.astype(np.int32))
                far += [d if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.concatenate(near)), pa.array(far, pa.int64())], names=[key, "cluster", "distance"])

    schema = rows.select(key).schema.add("cluster", "integer").add("distance", "long")
    return rows.select(key, "vec").mapInArrow(assign, schema), centroids


def report(found: DataFrame, centroids: list[list[int]], key: str = "vec_id") -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to (key, cluster, distance); sums that a long can't hold are null."""
    spark = found.sparkSession
    found = cut(found)
    wide = F.col("distance").cast("decimal(38,0)")
    own = found.groupBy("cluster").agg(F.sum(wide).alias("_s"), F.count_if(F.col("distance").isNull()).alias("_lost"))
    per = own.select("cluster", F.when(F.col("_lost") == 0, F.col("_s")).alias("_s"))
    every = own.agg(F.when(F.sum("_lost") == 0, F.sum("_s")).alias("_all"))
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    told = per.join(names, "cluster").join(every)  # a row a cluster, one row
    told = told.select("cluster", F.col("_s").try_cast("long").alias("cluster_inertia"), F.col("_all").try_cast("long").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` in 40 clusters after five rounds; see ``cluster`` for nulls, ties and repeats."""
    return report(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def oracle(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """DuckDB SQL: every distance of every round."""
    near = "(SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.rid, z.c, sum((x.v - z.v) * (x.v - z.v)) AS d FROM x JOIN {z} z USING (j) GROUP BY ALL) GROUP BY rid)"
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED {near.format(z=f"z{i}")},
m{i} AS (SELECT a.c, x.j, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN x USING (rid) GROUP BY a.c, x.j),
z{i + 1} AS MATERIALIZED (SELECT z.c, z.j, CASE WHEN m.n IS NULL THEN z.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v FROM z{i} z LEFT JOIN m{i} m USING (c, j))""")
    return f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT rid, unnest(range(1, {dim} + 1)) AS j, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM r),
p AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id), rid) - 1 AS c FROM r),
z0 AS MATERIALIZED (SELECT p.c, x.j, x.v FROM p JOIN x USING (rid) WHERE p.c < {k}),
{",".join(steps)},
f AS MATERIALIZED {near.format(z=f"z{rounds}")},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM z{rounds} GROUP BY c)
SELECT r.vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM f JOIN r USING (rid) JOIN h USING (c)
"""
