"""Packing of tokenized documents into sequences of a fixed window, planned by non-negative least squares.

Each document is cut into whole windows and a rest. The rests' lengths make a histogram of fewer than ``window`` cells,
all that reaches the driver. There, combinations of two or three lengths that fill a window are the columns of a
non-negative least-squares problem against the histogram; the repeat counts are rounded down, and what is left of the
histogram is packed greedily, length by length. The plan says, for each combination, how often it is repeated. A rest
finds its sequence and offset by its rank among the rests of its length, counted with salts, so that no task gathers a
length's rests.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, text_slices
from .tokens import encoder


def combinations(window: int, step: int) -> np.ndarray:
    """Pairs of lengths that fill the window, and triples whose smallest length is a multiple of ``step``: (n, 3), 0 for none."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    c = np.arange(step, window // 3 + 1, step)
    triples = [np.stack([b := np.arange(x, (window - x) // 2 + 1), window - x - b, np.full_like(b, x)], axis=1) for x in c]
    return np.concatenate([pairs, *triples]) if triples else pairs


def solve(columns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that make A x nearest to the histogram, by accelerated projected gradients.

    Column j of A counts the lengths of combination j. A is never built: its products are sums over the three lengths.
    """
    window = len(histogram) - 1
    used = columns > 0
    degree = np.bincount(columns[used], minlength=window + 1).astype(float)
    step = 1.0 / max(1.0, 3.0 * degree.max())
    # columns in the order of their chances: a start that is near the answer where lengths are even
    share = histogram / np.maximum(degree, 1)
    x = np.where(used, share[columns], np.inf).min(axis=1)
    y, momentum = x.copy(), 1.0
    weights = used.astype(float)
    for _ in range(rounds):
        fill = np.bincount(columns.ravel(), weights=(weights * y[:, None]).ravel(), minlength=window + 1)
        rest = fill - histogram
        rest[0] = 0
        gradient = (rest[columns] * weights).sum(axis=1)
        new = np.maximum(0, y - step * gradient)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y, x, momentum = new + (momentum - 1) / after * (new - x), new, after
    return x


def plan(histogram: np.ndarray, step: int = 32) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)] that use up the histogram (cell i: rests of length i; cell 0 is empty)."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    if not left.any():
        return out
    columns = combinations(window, step)
    columns = columns[((left[columns] > 0) | (columns == 0)).all(axis=1)]
    if len(columns):
        x = solve(columns, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            repeats = int(x[j])
            if repeats < 1:
                break
            lengths = [int(v) for v in columns[j] if v]
            repeats = min([repeats, *(int(left[v]) // lengths.count(v) for v in lengths)])
            if repeats:
                out.append((tuple(sorted(lengths, reverse=True)), repeats))
                for v in lengths:
                    left[v] -= repeats
    # the residuals: longest first, then the longest that still fits, as often as all of these lengths last
    while left.any():
        room, lengths = window, []
        taken = np.zeros_like(left)
        while True:
            fits = np.flatnonzero((left - taken)[: room + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            lengths.append(v)
            taken[v] += 1
            room -= v
        used = np.flatnonzero(taken)
        repeats = max(1, int((left[used] // taken[used]).min()))
        left -= taken * repeats
        out.append((tuple(lengths), repeats))
    return out


def pieces(docs: DataFrame, path: str, window: int, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(key, part, doc_tokens, start, length, ids_crc32): each document's ids, then ``end_id``, in whole windows and a rest."""
    schema = docs.select(key).schema.add("doc_tokens", "long").add("start", "long").add("length", "integer").add("ids_crc32", "long")

    def run(batches):
        model = encoder(path)
        for batch in text_slices(batches, text):
            texts = [s or "" for s in batch.column(text).to_pylist()]
            row, total, start, length, crc = [], [], [], [], []
            small = [s for s in texts if len(s) <= 1 << 16]
            found = iter(model.encode(small))
            for i, s in enumerate(texts):
                ids = next(found) if len(s) <= 1 << 16 else model.encode_long(s)
                ids = np.array([*ids, end_id], dtype="<u4").tobytes()
                n = len(ids) // 4
                for a in range(0, n, window):
                    piece = ids[4 * a : 4 * (a + window)]
                    row.append(i)
                    total.append(n)
                    start.append(a)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(row, pa.int64())), pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                names=[key, "doc_tokens", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = 1024, key: str = "doc_id", text: str = "text", salts: int | None = None, step: int = 32) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    ``padded``: the length that the sequence is padded to: the window, or its own length where that is a power of two.
    A null text is an empty one and has the end id alone; null keys are packed too; repeated rows are packed once each;
    an empty table gives no rows; columns other than key and text are not read. ``salts``: parts that a length's rests are
    counted in; by default 64, more for many pieces, 1024 at most.
    """
    # all that follows reads the pieces again, and must read the same ones in the same partitions
    every = cut(pieces(docs, path, window, key, text))
    salts = salts or max(64, min(1024, every.count() // 500_000))
    # the number of a row in what was cut tells repeated rows apart
    rows = every.filter(F.col("length") < window).withColumn("salt", F.pmod(F.xxhash64(F.col(key), "start", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    counts = cut(rows.groupBy("length", "salt").agg(F.count("*").alias("n")))  # fewer than window * salts rows
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # fewer than ``window`` rows
        histogram[row["length"]] = row["n"]
    ranges, first, seen = [], 0, np.zeros(window + 1, dtype=np.int64)
    for lengths, repeats in plan(histogram, step):
        size = sum(lengths)
        padded = size if size & (size - 1) == 0 else window
        offset = 0
        for v in sorted(set(lengths), reverse=True):
            times = lengths.count(v)
            ranges.append((v, int(seen[v]), int(seen[v]) + repeats * times, repeats, first, offset, padded))
            seen[v] += repeats * times
            offset += v * times
        first += repeats
    spark = docs.sparkSession
    # a few ranges for each length: bounded by the window, whatever the number of rests
    table = spark.createDataFrame(ranges, "length int, low long, high long, repeats long, first long, base int, padded int")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # ``salts`` rows a length
    within = Window.partitionBy("length", "salt").orderBy(F.col(key), "start", "ids_crc32")
    ranked = (
        rows.withColumn("i", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["length", "salt"])
        .withColumn("rank", F.col("i") + F.col("before"))
    )
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    own = [F.col(key), F.col("start"), ranked["length"].cast("long").alias("length"), F.col("ids_crc32"), F.col("doc_tokens")]
    rests = placed.select(
        *own,
        (F.col("first") + nth % F.col("repeats")).alias("sequence_id"),
        (F.col("base") + F.floor(nth / F.col("repeats")) * ranked["length"]).cast("long").alias("offset"),
        F.col("padded").cast("long").alias("padded"),
    )
    # whole windows are sequences of their own; their numbers follow those of the others, with gaps
    whole = every.filter(F.col("length") == window).select(
        key,
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(first) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(window).cast("long").alias("padded"),
    )
    return whole.unionByName(rests)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
