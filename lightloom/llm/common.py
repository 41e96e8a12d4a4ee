"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..components import cut, shared_dir  # noqa: F401

#: Bytes of text that a Python task turns into arrays at once; arrays over it take a few dozen times as much.
SLICE_BYTES = 1 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null keys fall into -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of, F.lit(-1))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; the plain lower() where the text is all ASCII, as it is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut into runs of rows with about ``limit`` bytes of text (one long text is never cut)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        run = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and the offsets of its texts in them; null texts are empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    _, offsets, data = whole.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(offs), dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_parts(data: np.ndarray, offs: np.ndarray, apart: np.ndarray, limit: int = SLICE_BYTES, overlap: int = 0):
    """(number of the first text, bytes, offsets) of parts with about ``limit`` bytes; longer texts are cut between words.

    apart: which bytes separate words. With ``overlap``, a part of a text begins so many words before the last one's end. A
    word longer than the limit is not cut.
    """
    edges = [0, *(np.flatnonzero(np.diff(offs[1:] // limit)) + 1).tolist(), len(offs) - 1]
    for a, b in zip(edges, edges[1:]):
        if b <= a:
            continue
        if b - a > 1 or offs[b] - offs[a] <= limit:
            yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            continue
        at, end = int(offs[a]), int(offs[b])
        gaps = np.flatnonzero(apart[at:end]) + at
        starts = gaps[:-1][np.diff(gaps) > 1]  # separators right before a word
        while at < end:
            stop = end
            if end - at > limit:
                i = int(np.searchsorted(gaps, at + limit))
                stop = int(gaps[i]) if i < len(gaps) else end
            after = stop
            while overlap and stop < end:
                after = int(starts[max(0, int(np.searchsorted(starts, stop)) - overlap)]) if len(starts) else stop
                if after > at:
                    break
                i += 1  # a part must hold more words than the overlap
                stop = int(gaps[i]) if i < len(gaps) else end
                after = stop
            yield a, data[at:stop], np.array([0, stop - at])
            at = after


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes, none of them over the edge of a text: (text, start, end)."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return np.searchsorted(offs, starts, side="right") - 1, starts, ends


#: An odd multiplier for polynomial hashes modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C55)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes (runs in order, not overlapping), a block of runs at a time."""
    out = np.zeros(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    edges = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(starts)]
    for i, j in zip(edges, edges[1:]):
        begin, sizes = starts[i:j], ends[i:j] - starts[i:j]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
        power = np.empty(int(sizes.max()), dtype=np.uint64)
        power[:] = _BASE
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        byte = data[at + np.repeat(begin, sizes)].astype(np.uint64) + np.uint64(1)
        out[i:j] = mix(np.add.reduceat(byte * power[at], first) ^ sizes.astype(np.uint64))
    return out


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by the text that they belong to."""
    return np.bincount(text, weights=values, minlength=n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(doc_id, y): one row for each labelled document; where rows disagree, 1 wins."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).cast("int").alias("y"))
    return rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))


def sampled(rows: DataFrame, marks: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` with their label y: of the marked keys that ``rows`` has, those with the ``most`` smallest hashes.

    Only keys are compared first; the chosen ones, bounded by ``most``, are then looked up where the rows lie.
    """
    known = marks.join(rows.select(key), key, "left_semi")
    chosen = known.withColumn("h", F.xxhash64(F.col(key))).orderBy("h", key).limit(most).drop("h")
    return rows.join(F.broadcast(chosen), key)
