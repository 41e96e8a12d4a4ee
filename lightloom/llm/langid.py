"""Language identification as inference in a mixture of languages.

Each language has a model of byte n-grams. A word's log-likelihood under a language is the mean over the n-grams in
and around it, times the word's length; a document is a mixture of languages whose proportions expectation-maximisation
estimates from its words. The language set is chosen by penalised likelihood: a further language must raise the
log-likelihood by more than a penalty that grows with the logarithm of the number of words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, hash_runs, mix, runs, text_slices, utf8, word_parts

ORDERS = (2, 3, 4)
BITS = 15
LETTER = re.compile(r"[^\W\d_]")
#: A-Z to lower case; a byte of a letter stays; all else is a space.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offs: np.ndarray):
    """(word's text, where its n-grams begin, cells, word's hash): cells[j] are the hashed n-grams of order ORDERS[j], one for
    each byte of a word and one for the space before it. They hold no bytes of other words: a word ends in spaces."""
    stream = _LETTERS[data]
    text, a, b = runs(stream != 32, offs)
    sizes, gap = b - a, max(ORDERS) - 1
    spaced = np.full(int((sizes + gap).sum()) + gap + 1, 32, dtype=np.uint64)
    own = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum()), dtype=np.int64)
    word = np.repeat(np.arange(len(sizes)), sizes)
    spaced[at + gap * word + 1] = stream[at + (a - own)[word]]
    n = len(spaced) - gap
    used = np.ones(n, dtype=bool)
    for k in range(1, gap):  # of the spaces between words, the last one alone begins an n-gram
        used[np.minimum(own + sizes + gap * np.arange(len(sizes)) + k, n - 1)] = False
    used[n - 1] = False
    cells = []
    for j, order in enumerate(ORDERS):
        h = np.full(n, j + 1, dtype=np.uint64)
        for k in range(order):
            h = (h << np.uint64(8)) | spaced[k : k + n]
        cells.append((mix(h[used]) & np.uint64((1 << BITS) - 1)).astype(np.int32))
    return text, own + np.arange(len(sizes)), cells, hash_runs(stream, a, b)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [order, cell, language]) from all rows with text and language.

    A task adds up its own rows; Spark adds up the tasks' cells, of which there are orders * 2**15 a language at most.
    """

    def count(batches):
        table: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, text):
            data, offs = utf8(batch.column(text))
            langs = batch.column(lang).to_pylist()
            for one in sorted({x for x in langs if x is not None}):
                mine = np.array([x == one for x in langs])
                keep = np.repeat(mine, np.diff(offs))
                sizes = np.where(mine, np.diff(offs), 0)
                counts = table.setdefault(one, np.zeros((len(ORDERS), 1 << BITS), dtype=np.int64))
                chosen = data[keep]
                for _, part, own in word_parts(chosen, np.concatenate([[0], np.cumsum(sizes)]), _LETTERS[chosen] == 32):
                    for j, c in enumerate(grams(part, own)[2]):
                        counts[j] += np.bincount(c, minlength=1 << BITS)
        for one, counts in table.items():
            j, c = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([one] * len(j), pa.string()), pa.array(j * (1 << BITS) + c, pa.int64()), pa.array(counts[j, c])], names=["lang", "cell", "n"]
            )

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, F.col(lang).cast("string").alias(lang))
    parts = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = parts.toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((len(langs), len(ORDERS) << BITS), 0.05)
    counts[np.searchsorted(langs, found["lang"]) if len(langs) else [], found["cell"].to_numpy()] += found["n"].to_numpy()
    counts = counts.reshape(len(langs), len(ORDERS), 1 << BITS)
    return langs, np.log(counts / counts.sum(axis=2, keepdims=True)).transpose(1, 2, 0).astype(np.float32)


def mixture(like: np.ndarray, count: np.ndarray, text: np.ndarray, allowed: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions [text, language], log-likelihood [text], room [text]) of mixtures over the allowed languages of each text.

    like: [word, language], relative to the word's best language; count: how often the text has the word; text: each
    word's text, in order, with no text left out. Log-likelihoods are relative to the best languages' too. ``room``
    bounds what any other proportions, over all languages, could add: by Jensen's inequality no more than the logarithm of
    the largest mean ratio of a language's likelihood to the mixture's, a word.
    """
    n = len(allowed)
    begins = np.searchsorted(text, np.arange(n))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    words = np.add.reduceat(count, begins)[:, None]
    weighted = like * count[:, None]
    for _ in range(rounds):
        total = np.maximum((like * share[text]).sum(axis=1), 1e-30)
        share = share * np.add.reduceat(weighted / total[:, None], begins, axis=0) / words
    total = np.maximum((like * share[text]).sum(axis=1), 1e-30)
    ratio = np.add.reduceat(weighted / total[:, None], begins, axis=0) / words
    return share, np.add.reduceat(np.log(total) * count, begins), words[:, 0] * np.log(np.maximum(ratio.max(axis=1), 1))


def word_scores(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times, log-likelihood [language]) of the distinct words of each text, by text. Long texts are taken in
    parts between words, so that the arrays over n-grams stay small."""
    found = []
    for base, part, own in word_parts(data, offs, _LETTERS[data] == 32):
        text, begin, cells, h = grams(part, own)
        if not len(text):
            continue
        # words once each before anything is looked up
        order = np.lexsort((h, text))
        new = np.append(True, (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1]))
        count = np.diff(np.append(np.flatnonzero(new), len(text))).astype(float)
        chosen = order[new]
        sizes = np.diff(np.append(begin, len(cells[0])))[chosen]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(begin[chosen] - first, sizes)
        total = table[0][cells[0][at]]
        for j in range(1, len(ORDERS)):
            total += table[j][cells[j][at]]
        ll = np.add.reduceat(total, first, axis=0).astype(np.float64) / len(ORDERS)
        found.append((text[chosen] + base, h[chosen], count, ll))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0), np.zeros((0, table.shape[2]))
    return found[0] if len(found) == 1 else distinct(*(np.concatenate(c) for c in zip(*found)))


def distinct(text, h, count, ll):
    """The words once each a text, with their counts added."""
    order = np.lexsort((h, text))
    text, h, count = text[order], h[order], count[order]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])))
    return text[new], h[new], np.add.reduceat(count, new), ll[order[new]]


def infer(data, offs, langs, table, penalty: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [text, language] of the chosen set, has words) for each text."""
    n, m = len(offs) - 1, len(langs)
    out = np.zeros((n, m))
    has = np.zeros(n, dtype=bool)
    text, _, count, ll = word_scores(data, offs, table)
    if not len(text):
        return out, has
    has[text] = True
    names, text = np.unique(text, return_inverse=True)
    below = np.maximum(ll - ll.max(axis=1, keepdims=True), -60)
    like = np.exp(below)
    begins = np.searchsorted(text, np.arange(len(names)))
    words = np.add.reduceat(count, begins)
    full, full_score, room = mixture(like, count, text, np.ones((len(names), m)))
    order = np.argsort(-full, axis=1, kind="stable")
    # one language: its proportion is 1
    best = np.zeros((len(names), m))
    np.put_along_axis(best, order[:, :1], 1.0, axis=1)
    best_score = np.take_along_axis(np.add.reduceat(below * count[:, None], begins, axis=0), order[:, :1], axis=1)[:, 0]
    for k in range(2, min(most, m) + 1):
        cost = penalty * (k - 1) * np.log(words + 1)
        # no mixture can be likelier than the full one and its room: most texts need no further fit
        open_ = np.flatnonzero(full_score + room - cost > best_score)
        if not len(open_):
            break  # the cost only grows
        if k == m:
            own, likelihood = full[open_], full_score[open_]
        else:
            allowed = np.zeros((len(open_), m))
            np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
            keep = np.isin(text, open_)
            own, likelihood, _ = mixture(like[keep], count[keep], np.searchsorted(open_, text[keep]), allowed)
        score = likelihood - cost[open_]
        better = score > best_score[open_] + 1e-9
        best[open_[better]] = own[better]
        best_score[open_[better]] = score[better]
    out[names] = best
    return out, has


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, key: str = "doc_id", text: str = "text", penalty: float = 4.0, most: int = 4) -> DataFrame:
    """(key, lang_pred, score, langs): the language with the largest share, its share, and the chosen set as name:share.

    A text that is null or has no letter, or any text where no language was learned, is ``und`` with score 0. Null keys
    and repeated rows pass through; an empty table gives none; other columns are not read.
    """
    schema = docs.select(key).schema.add("lang_pred", "string").add("score", "double").add("langs", "string")
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))  # orders * 2**15 floats a language

    def run(batches):
        langs, table = shared.value
        for batch in text_slices(batches, text, (1 << 21) // max(4, len(langs))):
            n = batch.num_rows
            pred, score, sets = ["und"] * n, np.zeros(n), [""] * n
            if langs:
                texts = batch.column(text)
                share, has = infer(*utf8(texts), langs, table, penalty, most)
                top = share.argmax(axis=1)
                for i, s in enumerate(texts.to_pylist()):
                    if has[i] and LETTER.search(s):
                        pred[i], score[i] = langs[top[i]], share[i, top[i]]
                        sets[i] = ",".join(f"{langs[j]}:{share[i, j]:.3f}" for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0.0005)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.string())], names=[key, "lang_pred", "score", "langs"]
            )

    return docs.select(key, text).mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those whose crc32 modulo 5 is not 0."""
    docs = documents(spark, sf_dir)
    langs, table = train(docs.filter(fold("doc_id", 5) != 0))
    return identify(docs, langs, table).withColumn("held_out", fold("doc_id", 5) == 0)
