"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

The unit is a window of a few words. Its vector is the mean of the embeddings of all its character n-grams (hashed
into buckets, word edges included), so a misspelling that was never seen shares most n-grams with the word that was;
a linear softmax over the mean gives the probability that the window is toxic. Only whole documents are labelled. At
first the model learns words, each with the shares of its contexts that stand in documents of either class (a context
counts once, however often documents copy it); then it learns windows: of toxic documents those that it found most
likely by then, against those of clean documents. A document's score is the calibrated margin of its worst window,
over its whole text.
"""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, hash_runs, labels, mix, runs, sampled, text_slices, utf8, word_parts

ORDERS = (3, 4, 5)
#: Learning documents, and bytes of their texts, of class 0 and class 1 at most: those with the smallest hashes of their keys.
SAMPLE = ((2000, 3 << 20), (2000, 2 << 20))
#: So many documents of a class (or all, if fewer) are in the sample however long they are: long ones by excerpts.
ALWAYS = 500
_WORD = np.full(256, 32, dtype=np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_WORD[[36, 42, 64]] = [36, 42, 64]  # $ * @ stand for letters now and then


def subwords(data: np.ndarray, offs: np.ndarray, buckets: int):
    """(text of each word, word of each n-gram, bucket of each n-gram), words in order."""
    stream = _WORD[data]
    text, a, b = runs(stream != 32, offs)
    sizes = b - a
    first = np.cumsum(sizes + 1) - sizes
    top = max(ORDERS)
    spaced = np.full(int((sizes + 1).sum()) + top + 1, 32, dtype=np.uint64)
    at = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spaced[at + np.repeat(first, sizes)] = stream[at + np.repeat(a, sizes)]
    n = len(spaced) - top
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)  # the space before a word belongs to it
    stop = np.repeat(first + sizes + 1, sizes + 1)  # and so does the one after it
    words, cells = [], []
    for order in ORDERS:
        start = np.flatnonzero(np.arange(len(owner)) + order <= stop)
        h = np.full(n, order, dtype=np.uint64)
        for k in range(order):
            h = (h << np.uint64(8)) | spaced[k : k + n]
        start = start[start < n]
        words.append(owner[start])
        cells.append((mix(h[start]) % np.uint64(buckets)).astype(np.int32))
    # the word itself is one of its subwords
    words.append(np.arange(len(sizes), dtype=np.int32))
    cells.append((hash_runs(stream, a, b) % np.uint64(buckets)).astype(np.int32))
    return text, np.concatenate(words), np.concatenate(cells)


def windows(text: np.ndarray, size: int) -> np.ndarray:
    """The first word of each run of ``size`` words of a text (one run for fewer words)."""
    begin = np.searchsorted(text, text)
    end = np.searchsorted(text, text, side="right")
    at = np.arange(len(text))
    return at[(at + size <= end) | (at == begin)]


class Model:
    """Embeddings [bucket, dim], softmax weights [dim, 2], bias [2] and the calibration of document margins."""

    def __init__(self, buckets: int = 1 << 16, dim: int = 8, size: int = 2, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.buckets, self.size = buckets, size
        self.embed = (rng.standard_normal((buckets, dim)) / dim).astype(np.float32)
        self.soft = (rng.standard_normal((dim, 2)) / np.sqrt(dim)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.slope, self.at = 1.0, 0.0

    def fit_bags(self, bags, cells, weight, rounds: int, rate: float, batch: int = 4096, seed: int = 0) -> None:
        """Adagrad on the softmax loss of bags. bags: each n-gram's bag, in order; cells: its bucket; weight [bag, class]."""
        rng = np.random.default_rng(seed)
        n = len(weight)
        begin = np.searchsorted(bags, np.arange(n + 1))
        weight = weight / weight.sum() * n
        seen_e = np.full(self.buckets, 1e-8, dtype=np.float32)
        seen_s = np.full_like(self.soft, 1e-6)
        for _ in range(rounds):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                own = order[i : i + batch]
                size = begin[own + 1] - begin[own]
                keep = size > 0
                own, size = own[keep], size[keep]
                if not len(own):
                    continue
                first = np.cumsum(size) - size
                at = np.arange(int(size.sum())) - np.repeat(first - begin[own], size)
                c = cells[at]
                mean = np.add.reduceat(self.embed[c], first, axis=0) / size[:, None]
                z = mean @ self.soft + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p = (p * weight[own].sum(1, keepdims=True) - weight[own]) / len(own)
                soft = mean.T @ p
                back = (p @ self.soft.T) / size[:, None]
                # buckets of the batch once each
                u, inverse = np.unique(c, return_inverse=True)
                rows = np.repeat(np.arange(len(own)), size)
                grad = np.stack([np.bincount(inverse, weights=back[rows, d], minlength=len(u)) for d in range(back.shape[1])], axis=1).astype(np.float32)
                seen_e[u] += (grad * grad).mean(1)
                self.embed[u] -= rate * grad / np.sqrt(seen_e[u])[:, None]
                seen_s += soft * soft
                self.soft -= (rate * soft / np.sqrt(seen_s)).astype(np.float32)
                self.bias -= rate * 0.1 * p.sum(0)

    def margins(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray | None = None):
        """(text of each window, its margin, first word): the softmax's log-odds of class 1."""
        table = self.table() if table is None else table
        text, word, cell = subwords(data, offs, self.buckets)
        if not len(text):
            return text, np.zeros(0), text
        total = np.concatenate([[0], np.cumsum(np.bincount(word, weights=table[cell], minlength=len(text)))])
        count = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(text)))])
        first = windows(text, self.size)
        last = np.minimum(first + self.size, np.searchsorted(text, text[first], side="right"))
        margin = (total[last] - total[first]) / np.maximum(count[last] - count[first], 1) + float(self.bias[1] - self.bias[0])
        return text[first], margin, first

    def table(self) -> np.ndarray:
        """What each bucket adds to a margin: the softmax is linear, so a mean of vectors is a mean of these numbers."""
        return (self.embed @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float64)

    def worst(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """The largest margin of each text; texts without words have the lowest one."""
        out = np.full(len(offs) - 1, -50.0)
        # long texts in parts that share a window's words but one, so that no window is missed
        for base, part, own in word_parts(data, offs, _WORD[data] == 32, overlap=self.size - 1):
            text, margin, _ = self.margins(part, own, table)
            np.maximum.at(out, text + base, margin)
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (worst - self.at), -40, 40)))


def _parts(offs: np.ndarray, limit: int = 1 << 18):
    """Ranges of texts with about ``limit`` bytes."""
    run = offs[1:] // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(offs) - 1]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _bags(data, offs, buckets, text, first, size):
    """n-grams of windows: (window of each, cell of each), by window. Only those of the windows' words are ever held."""
    last = np.minimum(first + size, np.searchsorted(text, text[first], side="right"))
    need = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(need, first, 1)
    np.add.at(need, last, -1)
    need = np.cumsum(need)[:-1] > 0
    words, cells, base = [], [], 0
    for a, b in _parts(offs):
        own, w, c = subwords(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], buckets)
        keep = need[base : base + len(own)][w]
        words.append(w[keep] + np.int32(base))
        cells.append(c[keep])
        base += len(own)
    word, cell = np.concatenate(words), np.concatenate(cells)
    order = np.argsort(word, kind="stable")
    word, cell = word[order], cell[order]
    begin = np.searchsorted(word, np.arange(len(text) + 1))
    n = begin[last] - begin[first]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin[first], n)
    return np.repeat(np.arange(len(first)), n), cell[at]


def _margins(model: Model, data, offs):
    """model.margins of all texts, a few of them at a time."""
    table, out, base = model.table(), [], 0
    for a, b in _parts(offs):
        own = offs[a : b + 1] - offs[a]
        part = data[offs[a] : offs[b]]
        of, margin, first = model.margins(part, own, table)
        out.append((of + a, margin, first + base))
        base += len(runs(_WORD[part] != 32, own)[0])
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))


def _learn_words(model: Model, data, offs, text, y, rounds: int, least: int, seed: int) -> None:
    """Words with ``least`` contexts or more, each a bag with the shares of its contexts by class."""
    _, a, b = runs(_WORD[data] != 32, offs)
    lowered = _WORD[data]
    h = hash_runs(lowered, a, b)
    edge = np.zeros(1, dtype=np.uint64)
    before, after = np.concatenate([edge, h[:-1]]), np.concatenate([h[1:], edge])
    context = mix(h * np.uint64(3) + mix(before) * np.uint64(5) + mix(after) * np.uint64(7))
    _, once = np.unique(context, return_index=True)  # copied passages count once
    names, at, which = np.unique(h[once], return_index=True, return_inverse=True)
    at = once[at]
    own = y[text[once]]
    pos, neg = (np.bincount(which, weights=own == k, minlength=len(names)) for k in (1, 0))
    keep = np.flatnonzero(pos + neg >= least)
    if not len(keep):
        return
    share = np.stack([neg / max(1, neg.sum()), pos / max(1, pos.sum())], axis=1)[keep]
    prior = 0.5 * least / max(1, min(neg.sum(), pos.sum()))
    share = (share + prior) / (share + prior).sum(1, keepdims=True) * np.minimum(50, (pos + neg)[keep])[:, None] ** 0.5
    order = np.argsort(at[keep])
    keep, share = keep[order], share[order]
    bags, cells = _bags(data, offs, model.buckets, text, at[keep], 1)
    model.fit_bags(bags, cells, share, 6 * rounds, 0.2, batch=1024, seed=seed)


def train(texts: list[str | None], y: np.ndarray, seed: int = 0, rounds: int = 3, least: int = 5, **shape) -> Model:
    """Learns from whole texts of a bounded sample; a fifth of them is kept back for the calibration.

    A sample of one class, or whose classes the model can't tell apart, gives a model by which no text is toxic.
    """
    model = Model(seed=seed, **shape)
    y = np.asarray(y, dtype=np.int64)
    if len(set(y.tolist())) < 2:
        model.at = np.inf
        model.embed[:] = 0
        return model
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back = np.ones(len(y), dtype=bool)
        learn = back
    else:
        learn = ~back
    data, offs = utf8(pa.array([t for t, own in zip(texts, learn) if own], pa.large_string()))
    own_y = y[learn]
    text, _, _ = runs(_WORD[data] != 32, offs)
    if len(text):
        _learn_words(model, data, offs, text, own_y, rounds, least, seed)
        of, margin, first = _margins(model, data, offs)
        toxic = own_y[of] == 1
        order = np.lexsort((-margin, of))
        rank = np.empty(len(of), dtype=np.int64)
        rank[order] = np.arange(len(of)) - np.searchsorted(of, of[order])
        cutoff = np.quantile(margin[~toxic], 0.9995) if (~toxic).any() else -np.inf
        rng = np.random.default_rng(seed)
        clean = ~toxic & ((rank < 3) | (rng.random(len(of)) < 0.2))
        chosen = np.flatnonzero((toxic & (margin > cutoff)) | clean)
        target = own_y[of[chosen]]
        if 0 < target.sum() < len(target):
            bags, cells = _bags(data, offs, model.buckets, text, first[chosen], model.size)
            weight = np.stack([(target == k) / (target == k).sum() for k in (0, 1)], axis=1)
            model.fit_bags(bags, cells, weight, rounds, 0.1, seed=seed + 1)
    data, offs = utf8(pa.array([t for t, own in zip(texts, back) if own], pa.large_string()))
    of, margin, _ = _margins(model, data, offs)
    worst = np.full(len(offs) - 1, -50.0)
    np.maximum.at(worst, of, margin)
    _calibrate(model, worst, y[back])
    return model


def _calibrate(model: Model, worst: np.ndarray, y: np.ndarray) -> None:
    """Places 0.3 where the best balance (F1) of the texts kept back is, in the middle of the gap.

    Where that cut finds toxic texts hardly more often than clean ones, the margins tell nothing, and no text is toxic.
    """
    order = np.argsort(-worst, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(worst[order]) < 0, True)
    best = int(np.argmax(np.where(last, f1, -1)))
    found, wrong = hit[best] / y.sum(), (best + 1 - hit[best]) / max(1, len(y) - y.sum())
    if found - wrong < 0.2:
        model.at = np.inf
        return
    here = worst[order[best]]
    after = worst[order[best + 1]] if best + 1 < len(order) else here - 1
    spread = max(1e-6, float(np.median(worst[y == 1]) - np.median(worst[y == 0])))
    model.slope = 6.0 / spread
    model.at = float((here + max(after, here - spread)) / 2) + np.log(0.7 / 0.3) / model.slope


def shares(sizes: np.ndarray, most_bytes: int, always: int = ALWAYS) -> tuple[int, np.ndarray]:
    """(level, chosen): documents of these sizes, in order, within so many bytes when those over the level are cut to it.

    The level is the largest at which the first ``always`` fit together; of the others only those that don't fit are left out.
    """
    head = np.sort(sizes[:always])
    ahead, after = np.cumsum(head) - head, len(head) - np.arange(len(head))
    over = np.flatnonzero(ahead + head * after > most_bytes)
    level = int((most_bytes - ahead[over[0]]) // after[over[0]]) if len(over) else most_bytes
    chosen, total = [], 0
    for i, n in enumerate(np.minimum(sizes, level).tolist()):
        if total + n <= most_bytes:
            chosen.append(i)
            total += n
    return level, np.array(chosen, dtype=np.int64)


def excerpt(text: Column, level: Column) -> Column:
    """Texts of more than ``level`` bytes: whole words from stretches of some 256 bytes, spread evenly over the text."""
    data, n = text.cast("binary"), F.octet_length(text)
    pieces = F.least(F.lit(64), F.greatest(F.lit(1), F.floor(level / 256))).cast("int")
    size = F.greatest(F.lit(1), F.floor(level / pieces) - 1).cast("int")
    start = lambda i: (F.floor((i + 0.5) * (n - size) / pieces) + 1).cast("int")
    whole = lambda i: F.regexp_replace(F.substring(data, start(i), size).cast("string"), r"^\S*\s|\s\S*$", " ")
    return F.when(n <= level, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), pieces - 1), whole), " "))


def learn(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text", sample=SAMPLE, always: int = ALWAYS, **shape) -> Model:
    """Trains on a bounded sample of labelled documents: of each class up to so many and so many bytes, repeated rows once.

    Only sizes and hashes are compared first, so no text moves that is not learned from; a task trains, not the driver. Where the labels have both
    classes and the sample has not, nothing can be learned, which is an error unless ``docs`` is empty.
    """
    rows = docs.select(key, text).filter(F.col(text).isNotNull())
    hashed = rows.withColumn("t", F.xxhash64(F.col(text)))
    chosen = []
    for y, (most, most_bytes) in enumerate(sample):
        own = sampled(hashed.select(key, "t", F.octet_length(text).alias("n")), marks.filter(F.col("y") == y), key, most).distinct()
        own = own.withColumn("h", F.xxhash64(F.col(key))).orderBy("h", key, "t").limit(most).collect()
        level, places = shares(np.array([r["n"] for r in own], dtype=np.int64), most_bytes, always)
        chosen += [(own[i][key], own[i]["t"], y, i, level) for i in places.tolist()]
    if len({c[2] for c in chosen}) < 2 and marks.filter(F.col("y").isin(0, 1)).select("y").distinct().count() == 2 and not rows.isEmpty():
        raise ValueError(f"labels have both classes, but the learning sample has {len(chosen)} documents of one class or none")
    if not chosen:
        return train([], np.zeros(0, dtype=np.int64), **shape)
    own = docs.sparkSession.createDataFrame(chosen, docs.select(key).schema.add("t", "long").add("y", "integer").add("at", "integer").add("level", "integer"))
    found = hashed.join(F.broadcast(own), [key, "t"]).select("y", "at", excerpt(F.col(text), F.col("level")).alias(text)).dropDuplicates(["y", "at"])

    def run(batches):
        picked = sorted((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("y", "at", text)))), key=lambda r: r[:2])
        picked = [r for pair in itertools.zip_longest(*(picked[i::7] for i in range(7))) for r in pair if r is not None]
        model = train([r[2] for r in picked], np.array([r[0] for r in picked], dtype=np.int64), **shape)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, so one task holds it; the driver, which has less room, gets the model alone
    return pickle.loads(found.repartition(1).mapInArrow(run, "model binary").first()["model"])


def rate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, from the whole text. Null and empty texts, and those without words, score lowest.

    Null keys and repeated rows pass through; an empty table gives none; other columns are not read.
    """
    small = Model.__new__(Model)
    small.__dict__ = {k: v for k, v in model.__dict__.items() if k not in ("embed", "soft")}
    table = model.table()

    def run(batches):
        for batch in text_slices(batches, text):
            data, offs = utf8(batch.column(text))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(small.score(small.worst(data, offs, table)))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, docs.select(key).schema.add("score", "double"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from labelled ones whose crc32 modulo 4 is not 2."""
    docs = documents(spark, sf_dir)
    model = learn(docs.filter(fold("doc_id", 4) != 2), labels(spark, sf_dir, "toxic"))
    return rate(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores below the threshold."""
    small = Model.__new__(Model)
    small.__dict__ = {k: v for k, v in model.__dict__.items() if k not in ("embed", "soft")}
    table = model.table()

    def run(batches):
        for batch in text_slices(batches, text):
            yield batch.filter(pa.array(small.score(small.worst(*utf8(batch.column(text)), table)) < threshold))

    return docs.mapInArrow(run, docs.schema)
