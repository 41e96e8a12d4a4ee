"""Nearest neighbours by cosine: a hierarchical navigable small-world graph for each shard, shard results merged.

Vectors are dealt to cells by their nearest centroid; centroids are fitted on a bounded sample, but every vector is
indexed. A cell is a shard, or several where it holds many vectors. A shard's graph is a row of flat arrays (ids,
vectors, and for each layer the nodes and a matrix of neighbour numbers), written once and read by every search. Both
building and searching work on many vectors at a time: a beam search keeps the best ``ef`` nodes of each of its
queries in matrices and expands several of them a step. Equal vectors are one node. A query visits the cells nearest to
it: as many as are needed to find the neighbours of sampled vectors within the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .neardup import grouped

#: Vectors of a cell: at least and at most, on average; between these, as many as give each core a cell. Cells at most.
SMALL, LARGE, CELLS = 4096, 65536, 1024
#: Queries of a slice, on average; sampled vectors that the centroids are fitted on, a cell; those that choose the number
#: of cells to visit, and the share of their neighbours that must be found so.
SLICE, SAMPLE, PROBED, SHARE = 65536, 64, 500, 0.99


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times a power of two that brings their largest component near to 1: no square overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def beam(neighbours: np.ndarray, row: np.ndarray | None, x: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, step: int = 8):
    """(nodes, similarities) [query, ef], best first, -1 for none: best-first search from ``entry`` [query] in one layer.

    neighbours: [row, degree], -1 for none; row: each node's row in it (None: its own number).
    """
    n, m = len(q), neighbours.shape[1]
    ids = np.full((n, ef), -1, dtype=np.int32)
    sims = np.full((n, ef), -np.inf, dtype=np.float32)
    ids[:, 0] = entry
    sims[:, 0] = (x[entry] * q).sum(axis=1)
    done = np.ones((n, ef), dtype=bool)
    done[:, 0] = False
    seen = np.zeros((n, len(x)), dtype=bool)
    seen[np.arange(n), entry] = True
    flat, worst = seen.reshape(-1), sims.min(axis=1)
    live = np.arange(n)
    step = min(step, ef)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_sims, step - 1, axis=1)[:, :step] if step < ef else np.tile(np.arange(ef), (len(live), 1))
        good = np.take_along_axis(open_sims, pick, axis=1) > -np.inf
        alive = good.any(axis=1)
        live, pick, good = live[alive], pick[alive], good[alive]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nodes = np.where(good, ids[live[:, None], pick], 0)
        near = neighbours.take(nodes if row is None else row[nodes], axis=0)
        near = np.where(good[:, :, None], near, -1).reshape(len(live), -1)
        at = live[:, None] * len(x) + near
        # a node may be the neighbour of several of the expanded ones: it counts once, and never again
        at = np.sort(at[(near >= 0) & ~flat.take(at, mode="clip")])
        if not len(at):
            continue
        at = at[np.append(True, at[1:] != at[:-1])]
        flat[at] = True
        who, node = np.divmod(at, len(x))
        value = np.einsum("ij,ij->i", x.take(node, axis=0), q.take(who, axis=0))
        better = value > worst[who]
        who, node, value = who[better], node[better], value[better]
        if not len(who):
            continue
        begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        rows, count = who[begin], np.diff(np.append(begin, len(who)))
        place = np.repeat(np.arange(len(rows)), count), ef + np.arange(len(who)) - np.repeat(begin, count)
        wide = ef + int(count.max())
        all_sims, all_ids, all_done = np.full((len(rows), wide), -np.inf, dtype=np.float32), np.full((len(rows), wide), -1, dtype=np.int32), np.zeros((len(rows), wide), dtype=bool)
        all_sims[:, :ef], all_ids[:, :ef], all_done[:, :ef] = sims[rows], ids[rows], done[rows]
        all_sims[place], all_ids[place] = value, node
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef] if wide > ef else np.arange(ef)[None]
        line = np.arange(len(rows))[:, None]
        sims[rows], ids[rows], done[rows] = all_sims[line, best], all_ids[line, best], all_done[line, best]
        worst[rows] = sims[rows].min(axis=1)
        done[rows] |= np.isneginf(sims[rows])
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def select(ids: np.ndarray, sims: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """[row, m] neighbours out of candidates (best first, -1 for none): those nearer to the node than to any chosen
    before, then the nearest of the others until there are m."""
    n, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, c), dtype=bool)
    closest = np.full((n, c), -np.inf, dtype=np.float32)
    count = np.zeros(n, dtype=np.int64)
    for j in range(c):
        take = (ids[:, j] >= 0) & (closest[:, j] < sims[:, j]) & (count < m)
        chosen[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rank = np.where(ids < 0, 2 * c + 1, np.arange(c) + np.where(chosen, 0, c))
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of flat arrays over the rows of x (float32, normalised)."""

    def __init__(self, x: np.ndarray, m: int = 24, ef: int = 128, seed: int = 0):
        self.x, self.m = x, m
        n = len(x)
        rng = np.random.default_rng(seed)
        levels = np.floor(-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64)
        if n:
            levels[0] = levels.max()
        self.rows, self.layers = [], []
        for level in range(int(levels.max()) + 1 if n else 0):
            nodes = np.flatnonzero(levels >= level)
            row = np.full(n, -1, dtype=np.int32)
            row[nodes] = np.arange(len(nodes))
            self.rows.append(None if level == 0 else row)
            self.layers.append(np.full((len(nodes), 2 * m if level == 0 else m), -1, dtype=np.int32))
        at, size = 1, 1
        while at < n:  # batches grow with the graph; nodes of a batch see each other too
            batch = np.arange(at, min(n, at + size))
            self._insert(batch, levels, ef)
            at += len(batch)
            size = min(256, max(1, at // 4))

    def _descend(self, q: np.ndarray, down_to: np.ndarray) -> tuple[np.ndarray, int]:
        entry = np.zeros(len(q), dtype=np.int32)
        for level in range(len(self.layers) - 1, 0, -1):
            go = np.flatnonzero(down_to < level)
            if len(go):
                entry[go] = beam(self.layers[level], self.rows[level], self.x, q[go], entry[go], 1)[0][:, 0]
        return entry

    def _insert(self, batch: np.ndarray, levels: np.ndarray, ef: int) -> None:
        q = self.x[batch]
        entry = self._descend(q, levels[batch])
        for level in range(int(levels[batch].max()), -1, -1):
            own = np.flatnonzero(levels[batch] >= level)
            ids, sims = beam(self.layers[level], self.rows[level], self.x, q[own], entry[own], ef)
            entry[own] = ids[:, 0]
            among = q[own] @ q[own].T
            np.fill_diagonal(among, -np.inf)
            peers = np.argsort(-among, axis=1)[:, : 2 * self.m]
            ids = np.concatenate([ids, np.where(np.isneginf(np.take_along_axis(among, peers, axis=1)), -1, batch[own][peers])], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among, peers, axis=1)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * self.m]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            links = select(ids, sims, self.x, self.m)
            row, layer = self.rows[level], self.layers[level]
            place = batch[own] if row is None else row[batch[own]]
            layer[place, : self.m] = links
            self._link_back(level, np.repeat(batch[own], self.m), links.ravel())

    def _link_back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        row, layer = self.rows[level], self.layers[level]
        place = nodes if row is None else row[nodes]
        wide = int(count.max())
        new = np.full((len(nodes), wide), -1, dtype=np.int32)
        new[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
        old = layer[place]
        new = np.where((new[:, :, None] == old[:, None, :]).any(axis=2), -1, new)  # links of two nodes of a batch to each other
        ids = np.concatenate([old, new], axis=1)
        degree = layer.shape[1]
        full = (ids >= 0).sum(axis=1) > degree
        easy = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), axis=1)[:, :degree]
        layer[place[~full]] = easy[~full]
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // 256)):
            if not len(part):
                continue
            own = ids[part]
            sims = np.matmul(self.x[np.maximum(own, 0)], self.x[nodes[part]][:, :, None])[:, :, 0]
            sims = np.where(own >= 0, sims, -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : degree + 2 * self.m]
            layer[place[part]] = select(np.take_along_axis(own, order, axis=1), np.take_along_axis(sims, order, axis=1), self.x, degree)

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.layers:
            return np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        entry = self._descend(q, np.zeros(len(q), dtype=np.int64))
        ids, sims = beam(self.layers[0], None, self.x, q, entry, max(k, ef))
        return ids[:, :k], sims[:, :k]

    def pack(self) -> dict[str, bytes]:
        nodes = [np.arange(len(self.x)) if r is None else np.flatnonzero(r >= 0) for r in self.rows]
        return {
            "shape": np.array([self.m, len(self.layers), *(len(v) for v in nodes)], dtype=np.int64).tobytes(),
            "nodes": b"".join(v.astype(np.int32).tobytes() for v in nodes),
            "links": b"".join(v.tobytes() for v in self.layers),
        }

    @classmethod
    def unpack(cls, x: np.ndarray, shape: bytes, nodes: bytes, links: bytes) -> Graph:
        self = cls.__new__(cls)
        self.x = x
        self.m, depth, *sizes = np.frombuffer(shape, dtype=np.int64).tolist()
        nodes, links = np.frombuffer(nodes, dtype=np.int32), np.frombuffer(links, dtype=np.int32)
        self.rows, self.layers = [], []
        for level, size in enumerate(sizes[:depth]):
            row = np.full(len(x), -1, dtype=np.int32)
            row[nodes[:size]] = np.arange(size)
            degree = 2 * self.m if level == 0 else self.m
            self.rows.append(None if level == 0 else row)
            self.layers.append(links[: size * degree].reshape(size, degree))
            nodes, links = nodes[size:], links[size * degree :]
        return self


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim, id, v) of the vectors that take part: a key, components that are all finite numbers, not all zero.

    Of rows with the same key, the smallest vector counts.
    """
    kind = vectors.schema[vector].dataType.elementType.typeName()
    v = F.col(vector) if kind == "float" else F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))
    rows = rows.filter(F.col("id").isNotNull() & (F.col("dim") > 0) & ~bad & F.exists("v", lambda c: c != 0))
    return rows.groupBy("dim", "id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(dim, v, ids): each vector once, with the ``most`` smallest of its ids: no answer holds more of them."""
    own = Window.partitionBy("dim", "v").orderBy("id")
    few = rows.withColumn("i", F.row_number().over(own)).filter(F.col("i") <= most)
    return few.groupBy("dim", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, dim)


class Cells:
    """Centroids of one dimension, and how many of the nearest cells a query visits."""

    def __init__(self, sample: np.ndarray, cells: int, k: int, seed: int = 0, rounds: int = 12):
        x = normalised(sample).astype(np.float32)
        cells = max(1, min(cells, len(x)))
        rng = np.random.default_rng(seed)
        self.centroids = x[rng.choice(len(x), cells, replace=False)]
        for _ in range(rounds if cells > 1 else 0):
            own = self.order(x, 1)[:, 0]
            total = np.zeros_like(self.centroids)
            np.add.at(total, own, x)
            length = np.sqrt((total * total).sum(axis=1, keepdims=True))
            self.centroids = np.where(length > 1e-9, total / np.maximum(length, 1e-9), self.centroids)
        self.visits = cells
        if cells > 1:
            q = x[:PROBED]
            near = q @ x.T
            near[np.arange(len(q)), np.arange(len(q))] = -2
            best = np.argpartition(-near, min(k, len(x) - 1), axis=1)[:, :k]
            rank = np.argsort(self.order(q, cells), axis=1)
            where = np.take_along_axis(rank, self.order(x, 1)[:, 0][best], axis=1)
            found = np.cumsum(np.bincount(where.ravel(), minlength=cells)) / where.size
            self.visits = min(cells, int(np.searchsorted(found, SHARE)) + 1)

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """[row, most]: the cells nearest to each row, nearest first."""
        near = x @ self.centroids.T
        return near.argmax(axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most]


def fit_cells(nodes: DataFrame, k: int, size: int | None) -> tuple[dict, int]:
    """({dim: Cells}, vectors of a cell) from a sample of at most SAMPLE * CELLS vectors a dimension.

    A dimension with few vectors has no entry: they are one cell. So there are no more entries than cells.
    """
    counts = nodes.groupBy("dim").agg(F.count("*").alias("n"))
    total = nodes.count()
    size = size or max(SMALL, min(LARGE, -(-total // nodes.sparkSession.sparkContext.defaultParallelism)))
    found = {}
    for dim, n in counts.filter(F.col("n") > size).collect():
        cells = min(CELLS, -(-n // size))
        rows = nodes.filter(F.col("dim") == dim).select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE * cells).toArrow()
        found[dim] = Cells(matrix(rows.column("v"), dim), cells, k)
    return found, size


def in_cells(rows: DataFrame, cells: dict, all_visited: bool) -> DataFrame:
    """Adds ``cell``: the nearest one, or (all_visited) a row for each of those that a query visits."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    schema = rows.withColumn("cell", F.lit(0)).schema

    def run(batches):
        cells = shared.value
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                at, cell = np.arange(part.num_rows), np.zeros(part.num_rows, dtype=np.int32)
                if dim in cells:
                    own = cells[dim]
                    order = own.order(normalised(matrix(part.column("v"), dim)).astype(np.float32), own.visits if all_visited else 1)
                    at, cell = np.repeat(at, order.shape[1]), order.ravel().astype(np.int32)
                out = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell)], names=[*out.schema.names, "cell"])

    return rows.mapInArrow(run, schema)


def build(nodes: DataFrame, m: int, ef: int) -> DataFrame:
    """The index: (shard, dim, ids, first, vectors, ...), a row for each shard, from (shard, dim, v, ids), a shard a partition.

    first holds where each node's ids begin.
    """
    single = nodes.schema["v"].dataType.elementType.typeName() == "float"

    def run(batches):
        for group in grouped(batches, "shard"):
            dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
            x = matrix(group.column("v"), dim)
            order = np.lexsort(x.T[::-1])  # whichever way the rows came
            order = order[np.random.default_rng(shard).permutation(len(order))]  # sorted vectors make a poor order of insertion
            x, ids = x[order], group.column("ids").combine_chunks().take(pa.array(order))
            graph = Graph(normalised(x).astype(np.float32), m, ef, seed=shard)
            first = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]).astype(np.int64)
            flat = {"ids": np.asarray(ids.flatten()).tobytes(), "vectors": x.astype(np.float32 if single else np.float64).tobytes(), **graph.pack(), "first": first.tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([v], pa.binary()) for v in flat.values())], names=["shard", "dim", *flat])

    return nodes.mapInArrow(run, "shard int, dim int, ids binary, vectors binary, shape binary, nodes binary, links binary, first binary")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", m: int = 16, ef_build: int = 64, ef: int = 128, cell_size: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of ``vectors`` but those with its own key.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null keys; vectors
    of other dimensions are not compared. Of rows with the same key, the smallest vector counts. Equal scores are ties,
    which go to smaller keys. Fewer candidates than k give fewer rows; an empty table gives
    none. Scores are cosines of the original vectors in double precision. Other columns are not read.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    nodes = cut(distinct_vectors(usable(vectors, key, vector), k + 1))
    cells, size = fit_cells(nodes, k, cell_size)
    dealt = cut(in_cells(nodes, cells, False))
    # a row a cell: a cell of more vectors than LARGE (or two sizes) is several shards, by the hash of the vector
    shards, number = {}, 0
    for dim, cell, n in sorted(dealt.groupBy("dim", "cell").agg(F.count("*")).collect()):
        parts = -(-n // (2 * size))
        shards[dim, cell] = (number, parts)
        number += parts
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = spark.createDataFrame([(*at, *to) for at, to in shards.items()], "dim int, cell int, at int, parts int")
    placed = dealt.join(F.broadcast(table), ["dim", "cell"]).withColumn("shard", (F.col("at") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int"))
    index = cut(build(placed.select("shard", "dim", "v", "ids").repartitionById(number, F.col("shard")), m, ef_build))
    asked = in_cells(usable(queries, key, vector), cells, True).join(F.broadcast(table), ["dim", "cell"])
    asked = cut(asked.select("id", "v", F.explode(F.sequence("at", F.col("at") + F.col("parts") - 1)).alias("shard")))
    # a shard's queries are dealt to as many tasks as their own number asks for, however they are spread over shards
    slices = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")))  # two numbers a shard
    left = index.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    right = asked.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int")).drop("slices")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            flat = {c: left.column(c)[0].as_py() for c in ("ids", "vectors", "shape", "nodes", "links", "first")}
            ids, first = np.frombuffer(flat["ids"], dtype=np.int64), np.frombuffer(flat["first"], dtype=np.int64)
            x = np.frombuffer(flat["vectors"], dtype=np.float32 if single else np.float64).reshape(-1, dim)
            graph = Graph.unpack(normalised(x).astype(np.float32), flat["shape"], flat["nodes"], flat["links"])
            own = np.asarray(right.column("id"))
            q = matrix(right.column("v"), dim)
            for a in range(0, len(own), 256):
                part = scaled(q[a : a + 256])
                lengths = np.sqrt((part * part).sum(axis=1))
                found, _ = graph.search((part / lengths[:, None]).astype(np.float32), min(len(x), 4 * k + 4), ef)
                for i, nodes in enumerate(found):
                    nodes = nodes[nodes >= 0]
                    near = scaled(x[nodes])
                    score = np.clip((near * part[i]).sum(axis=1) / (np.sqrt((near * near).sum(axis=1)) * lengths[i]), -1, 1)
                    pairs = []
                    for node, s in zip(nodes, score.tolist()):
                        pairs += [(-s, v, s) for v in ids[first[node] : first[node + 1]].tolist() if v != own[a + i]]
                    pairs.sort()
                    out[0] += [own[a + i]] * len(pairs[:k])
                    out[1] += [v for _, v, _ in pairs[:k]]
                    out[2] += [s for _, _, s in pairs[:k]]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=names)

    by = ["shard", "slice"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
