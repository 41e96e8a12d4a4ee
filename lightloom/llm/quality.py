"""Document quality by Bradley-Terry ranking.

A document's worth is a linear function of features of its whole text; that one document is preferred to another has
the probability sigmoid(difference of worths). The weights are learned by logistic loss on feature differences of all
preference pairs (a document of label 1 over one of label 0), of all learning documents. A quantile of their worths is
the threshold: as many of them lie above it as have label 1. Scores are worths on a logistic scale that puts the threshold at 0.3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import quantiles
from .common import cut, documents, fold, hash_runs, labels, per_text, runs, text_slices, utf8, word_parts

#: Characters that are counted each for themselves.
MARKS = b".,;:!?|#$%&*<>{}()[]=_-/\\\"'@~^+`"
#: Marks over which worths are counted; a worth counts for both marks beside it, so that only curvature within a mark is lost.
CELLS = 8192


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    order = np.argsort(h)
    order = order[np.argsort(of[order], kind="stable")]
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return np.bincount(of[new], minlength=n).astype(float)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[text, feature]: shares of characters, words and lines of each whole text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    chars = np.maximum(size, 1)
    counts = np.zeros((n, 256))
    for base, part, own in word_parts(data, offs, data <= 32):
        text = np.repeat(np.arange(len(own) - 1), np.diff(own))
        counts[base : base + len(own) - 1] += np.bincount(text * 256 + part, minlength=256 * (len(own) - 1)).reshape(-1, 256)
    upper, lower = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1)
    digit, high = counts[:, 48:58].sum(1), counts[:, 128:].sum(1)
    letters = upper + lower + high
    marks = counts[:, list(MARKS)]
    out = [upper / np.maximum(upper + lower, 1), digit / chars, high / chars, letters / chars, counts[:, 10] / chars, counts[:, 32] / chars, counts[:, 9] / chars, *(marks / chars[:, None]).T, marks.sum(1) / chars]
    of, a, b = runs(data > 32, offs)
    words = np.bincount(of, minlength=n).astype(float)
    each = np.maximum(words, 1)
    length = (b - a).astype(float)
    mean = per_text(length, of, n) / each
    spread = np.sqrt(np.maximum(per_text(length * length, of, n) / each - mean * mean, 0))
    h = hash_runs(data, a, b)
    distinct = _distinct(of, h, n)
    last = data[b - 1] if len(b) else data[:0]
    start = data[a] if len(a) else data[:0]
    is_letter = np.zeros(256, dtype=bool)
    is_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    second = data[np.minimum(a + 1, len(data) - 1)] if len(a) else data[:0]
    upper_words = per_text(((start >= 65) & (start <= 90) & (b - a > 1) & (second >= 65) & (second <= 90)).astype(float), of, n)
    bare = per_text((~is_letter[last]).astype(float), of, n) / each
    alone = per_text(((b - a == 1) & ~is_letter[start]).astype(float), of, n) / each
    out += [np.log1p(size), np.log1p(words), mean, spread, distinct / each, upper_words / each, bare, alone, per_text((length > 20).astype(float), of, n) / each]
    lt, la, lb = runs(data != 10, offs)
    lines = np.maximum(np.bincount(lt, minlength=n).astype(float), 1)
    lh = hash_runs(data, la, lb)
    out += [_distinct(lt, lh, n) / lines, np.log1p(lines), np.log1p(size / lines)]
    found = np.stack(out, axis=1)
    # shares are small and skewed: their square roots are features too
    return np.concatenate([found, np.sqrt(np.maximum(found, 0))], axis=1).astype(np.float32)


def width() -> int:
    """How many features a text has."""
    return features(np.zeros(0, dtype=np.uint8), np.zeros(2, dtype=np.int64)).shape[1]


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features) of every row; a null text is an empty one."""

    def run(batches):
        for batch in text_slices(batches, text):
            found = features(*utf8(batch.column(text)))
            values = pa.array(found.ravel())
            offsets = pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, values)], names=[key, "features"])

    return docs.select(key, text).mapInArrow(run, _schema(docs, key))


def _schema(docs: DataFrame, key: str):
    from pyspark.sql.types import ArrayType, FloatType

    return docs.select(key).schema.add("features", ArrayType(FloatType()))


class Ranking:
    """Weights of the worths, the threshold and the scale; picklable."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float = 1.0, steep: float = 2.0):
        self.mean, self.weights = mean, weights
        self.scale = np.where(scale > 1e-9, scale, np.inf)
        self.threshold, self.steep = threshold, steep

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.steep * (self.worth(x) - self.threshold) + np.log(0.3 / 0.7), -40, 40)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("features").flatten()).reshape(batch.num_rows, -1).astype(float)


def summed(known: DataFrame, of, size: int) -> np.ndarray:
    """Sums over all rows of the ``size`` numbers that of(features, labels) gives for a few rows: tasks add up their own, Spark the tasks'."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch), np.asarray(batch.column("y")))
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(total[places])], names=["place", "value"])

    out = np.zeros(size)
    for r in known.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def _cells(worth: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The mark below each worth, of CELLS from -reach to reach, and the part of the way to the next one."""
    at = (worth + reach) / (2 * reach) * (CELLS - 1)
    low = np.clip(np.floor(at).astype(np.int64), 0, CELLS - 2)
    return low, at - low


def losses(counts: np.ndarray, reach: float) -> np.ndarray:
    """[class, mark]: the mean probability that a document of class 0 is preferred to one of class 1 whose worth is at the
    mark, and that one of class 0 there is preferred to those of class 1. counts [class, mark]: the documents by worth."""
    n = 2 * CELLS - 1
    apart = np.arange(1 - CELLS, CELLS) * (2 * reach / (CELLS - 1))
    kernel = np.fft.rfft(1 / (1 + np.exp(-np.clip(apart, -40, 40))), 2 * n)
    share = counts / counts.sum(1, keepdims=True)
    # at mark m: the sum over marks k of share[k] * sigmoid(m - k)
    over = [np.fft.irfft(np.fft.rfft(s, 2 * n) * kernel, 2 * n)[CELLS - 1 : n] for s in share]
    return np.stack([1 - over[0], over[1]])[::-1]


def _inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a positive definite matrix, by elimination in place: threaded LAPACK hung in a driver beside its JVM."""
    a = a.copy()
    for k in range(len(a)):
        pivot, row, column = a[k, k], a[k] / a[k, k], a[:, k].copy()
        a -= column[:, None] * row
        a[k], a[:, k], a[k, k] = row, -column / pivot, 1 / pivot
    return a


def learn(known: DataFrame, rounds: int = 12, ridge: float = 1e-4) -> Ranking:
    """The ranking by all pairs of a label 1 and a label 0 among ``known`` (features, y), every row of it.

    The gradient over all pairs is a sum over rows, as a row's part hangs on its worth and on how the other class's worths
    are spread: a round counts the worths over CELLS marks (each between its two marks), then sums the rows' parts. Steps
    are accelerated, by a bound of the curvature from the moments of both classes. Only sums reach the driver.
    """
    d = width()
    ends = summed(known, lambda x, y: np.concatenate([[(y == 0).sum(), (y == 1).sum()], x.sum(0)]), d + 2)
    n = ends[:2]
    model = Ranking(ends[2:] / max(1, n.sum()), np.zeros(d), np.zeros(d))
    if not n.sum():
        return model
    mean = model.mean
    model = Ranking(mean, np.sqrt(summed(known, lambda x, y: ((x - mean) ** 2).sum(0), d) / n.sum()), model.weights)
    if not n.all():
        return Ranking(mean, model.scale, model.weights, -1.0 if n[1] else 1.0)

    def moments(x, y):
        z = model.standard(x)
        return np.concatenate([np.concatenate([z[y == k].sum(0), (z[y == k].T @ z[y == k]).ravel()]) for k in (0, 1)])

    found = summed(known, moments, 2 * (d + d * d)).reshape(2, -1) / n[:, None]
    means, squares = found[:, :d], found[:, d:].reshape(2, d, d)
    cross = np.outer(means[0], means[1])
    step = _inverse((squares.sum(0) - cross - cross.T) / 4 + ridge * np.eye(d))
    now = ahead = np.zeros(d)
    pace = 1.0
    for _ in range(rounds):
        at = Ranking(mean, model.scale, ahead)
        reach = 8 * np.abs(ahead).sum() + 1.0

        def counted(x, y, at=at, reach=reach):
            low, part = _cells(at.worth(x), reach)
            place = low + y * CELLS
            return np.bincount(place, 1 - part, 2 * CELLS) + np.bincount(place + 1, part, 2 * CELLS)

        table = losses(summed(known, counted, 2 * CELLS).reshape(2, CELLS), reach)

        def slopes(x, y, at=at, reach=reach, table=table):
            z = at.standard(x)
            low, part = _cells(z @ at.weights, reach)
            return (np.where(y == 1, -1, 1) / n[y] * (table[y, low] * (1 - part) + table[y, low + 1] * part)) @ z

        slope = summed(known, slopes, d) + ridge * ahead
        after = ahead - (step * slope).sum(1)
        if slope @ (after - now) > 0:  # past the lowest place: start again without momentum
            pace = 1.0
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, now, pace = after + (pace - 1) / faster * (after - now), after, faster
    return _placed(known, Ranking(mean, model.scale, now), n[1] / n.sum())


def _placed(known: DataFrame, model: Ranking, share: float) -> Ranking:
    """``model`` with the threshold that the ``share`` of all learning rows lies above, and the scale of their worths."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.worth(_matrix(batch)))], names=["worth"])

    worths = cut(known.select("features").mapInArrow(run, "worth double"))
    at = quantiles(worths, "worth", [1 - share]).first()["threshold"]
    above, below, spread = worths.agg(F.min(F.when(F.col("worth") >= at, F.col("worth"))), F.max(F.when(F.col("worth") < at, F.col("worth"))), F.stddev_pop("worth")).first()
    # the quantile itself may fall between the classes: a little slack to either side changes no share by much
    threshold = at if above is None or below is None else (above + below) / 2
    return Ranking(model.mean, model.scale, model.weights, threshold, 2 / max(1e-6, spread or 1.0))


def fit(rows: DataFrame, marks: DataFrame, key: str = "doc_id") -> Ranking:
    """Learns from all of (key, features) that (key, y) marks.

    Without rows to learn from, or with one class alone, all worths are equal: each text gets the class that was seen
    (0, if none was).
    """
    return learn(cut(rows.join(marks, key).select("features", F.col("y").cast("long").alias("y"))))


def rate(rows: DataFrame, model: Ranking, key: str = "doc_id") -> DataFrame:
    """(key, score) from (key, features)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(model.score(_matrix(batch)))], names=[key, "score"])

    return rows.mapInArrow(run, rows.select(key).schema.add("score", "double"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from labelled ones whose crc32 modulo 5 is not 0.

    Null and empty texts are scored as texts without characters; repeated rows give repeated results; labels that are
    null or not 0 or 1 are not learned from; without labels of both classes all worths are equal. An empty table gives
    none; other columns are not read. A very long text takes some 30 times its bytes in arrays.
    """
    rows = cut(with_features(documents(spark, sf_dir)))
    model = fit(rows.filter(fold("doc_id", 5) != 0), labels(spark, sf_dir, "quality"))
    return rate(rows, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
