"""Secret scans: fixed rules, widened by two character Markov models.

One model holds random strings, the other ordinary identifiers; both are first-order chains over bytes, trained from
labelled samples: random strings over the alphabets that keys are made of, and the identifiers of the corpus itself. A
long token that no rule covers is a secret if its mean log-likelihood ratio a character is above a threshold.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_slices

#: The rules, in the order in which spans that start together are listed.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
ORDER = {"assign": 0, "access": 1, "hex": 2, "markov": 3}
#: Tokens that the models judge, from LONG characters, and those that they learn ordinary identifiers from, below.
LONG = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LONG)
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: What keys are made of, a class of random samples each.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    _LOWER, _UPPER, _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/",
    _LOWER + _UPPER + _DIGITS + "-_", _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567",
)
#: Of a hexadecimal run, only those with this many characters are looked at again by the rule.
_HEX = re.compile(r"[0-9a-f]{24,}")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
_CODE = np.full(256, SIZE - 1, dtype=np.int64)
_CODE[list(ALPHABET)] = np.arange(SIZE - 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) that the rules find, in code points."""
    found = []
    for kind, rule, group, least in RULES:
        for m in (_HEX if kind == "hex" else rule).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return found


def random_strings(each: int = 800, seed: int = 1) -> list[str]:
    """``each`` random strings of 16 to 63 characters over each alphabet: the samples of label 1."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), int(n))) for alphabet in ALPHABETS for n in rng.integers(16, 64, each)]


def folded(token: str) -> str:
    """Words in capitals, or with a capital first, are judged as their lower-case forms, of which samples are many."""
    return token.lower() if token.isalpha() and (token.isupper() or token[1:].islower()) else token


def bigrams(tokens: list[str]) -> np.ndarray:
    """Counts of neighbouring characters over all tokens."""
    joined = "\n".join(tokens).encode("ascii", "replace")
    code = _CODE[np.frombuffer(joined, dtype=np.uint8)]
    counts = np.bincount(code[:-1] * SIZE + code[1:], minlength=SIZE * SIZE) if len(code) > 1 else np.zeros(SIZE * SIZE, dtype=np.int64)
    return counts


class MarkovPair:
    """Log-likelihood ratio of two first-order chains, smoothed by how often each character stands second at all."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, prior: float = 0.5):
        def chain(counts):
            c = counts.reshape(SIZE, SIZE).astype(float)[: SIZE - 1, : SIZE - 1]
            single = c.sum(axis=0) + prior
            c += prior * (SIZE - 1) * single / single.sum()
            return np.log(c / c.sum(axis=1, keepdims=True))

        self.ratio = chain(random) - chain(ordinary)

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio a transition: above 0, the token is more like a random string."""
        code = _CODE[np.frombuffer(folded(token).encode("ascii", "replace"), dtype=np.uint8)]
        code = code[code < SIZE - 1]
        return float(self.ratio[code[:-1], code[1:]].mean()) if len(code) > 1 else 0.0


def train(samples: DataFrame, prior: float = 0.5) -> MarkovPair:
    """Both chains from labelled samples (text, label): label 1 for random strings, 0 for ordinary identifiers.

    Each task counts its own rows into one table of (69 x 69) cells a label; Spark adds these up, so all rows count and
    a few thousand cells reach the driver. Rows without text or label count nothing.
    """

    def count(batches):
        total = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for batch in batches:
            table = [[], []]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and label in (0, 1):
                    table[label].append(folded(text))
            for label in (0, 1):
                total[label] += bigrams(table[label])
        label, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(cell), pa.array(total[label, cell])], names=["label", "cell", "n"])

    return _fit(samples.select("text", "label").mapInArrow(count, "label long, cell long, n long"), prior)


def _fit(counts: DataFrame, prior: float, drawn: np.ndarray | None = None) -> MarkovPair:
    table = np.zeros((2, SIZE * SIZE))
    if drawn is not None:
        table[1] = drawn
    for row in counts.groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():  # at most 2 * 69 * 69 rows
        table[row["label"], row["cell"]] += row["n"]
    return MarkovPair(table[1], table[0], prior)


def train_from_corpus(docs: DataFrame, text: str = "text", prior: float = 0.5, random: list[str] | None = None) -> MarkovPair:
    """Label 1: ``random`` (by default random_strings()); label 0: tokens of all texts that are too short to be judged
    (a secret never teaches that it is ordinary), but for digits and what the rules find."""

    def count(batches):
        total = np.zeros(SIZE * SIZE, dtype=np.int64)
        for batch in text_slices(batches, text):
            ordinary = []
            for s in batch.column(text).to_pylist():
                if not s:
                    continue
                at = 0
                for a, b, _ in sorted(base_spans(s)):
                    if a > at:
                        ordinary += IDENTIFIER.findall(s, at, a)
                    at = max(at, b)
                ordinary += IDENTIFIER.findall(s, at)
            total += bigrams([folded(x) for x in ordinary if len(x) < LONG and not x.isdigit()])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cell), dtype=np.int64)), pa.array(cell), pa.array(total[cell])], names=["label", "cell", "n"])

    drawn = bigrams([folded(x) for x in (random_strings() if random is None else random)])
    return _fit(docs.select(text).mapInArrow(count, "label long, cell long, n long"), prior, drawn)


def find(text: str, model: MarkovPair | None, threshold: float) -> tuple[list, list]:
    """(spans of the rules, all spans), each sorted by start, then kind."""
    key = lambda s: (s[0], ORDER[s[2]], s[1])
    base = sorted(base_spans(text), key=key)
    if model is None:
        return base, base
    added, i, reach = [], 0, 0
    for m in TOKEN.finditer(text):  # tokens and spans are both in order: each span is looked at once
        a, b = m.span()
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][1])
            i += 1
        token = m[0]
        if token.isdigit() or reach > a:
            continue  # numbers are no secrets, and the rules' spans are told already
        if model.score(token) > threshold:
            added.append((a, b, "markov"))
    return base, sorted(base + added, key=key) if added else base


def _listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, model: MarkovPair | None, key: str = "doc_id", text: str = "text", threshold: float = 0.5, redact: str | None = None) -> DataFrame:
    """One row a document: key, counts a rule, ``base_spans``, ``spans``, ``n_markov``, and ``clean``: the text with spans replaced.

    A null text is an empty one; a null key stays null; repeated rows give repeated results; an empty table gives none.
    Other columns of ``docs`` are not read. ``clean`` is null unless ``redact`` is given.
    """
    schema = docs.select(key).schema

    def run(batches):
        for batch in text_slices(batches, text):
            rows = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_markov", "base_spans", "spans", "clean")}
            for s in batch.column(text).to_pylist():
                s = s or ""
                base, every = find(s, model, threshold)
                for kind in ("assign", "access", "hex"):
                    rows[f"n_{kind}"].append(sum(x[2] == kind for x in base))
                rows["n_markov"].append(len(every) - len(base))
                rows["base_spans"].append(_listed(base))
                rows["spans"].append(_listed(every))
                rows["clean"].append(None if redact is None else _replaced(s, every, redact))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(rows[n], pa.int64()) for n in list(rows)[:4]), *(pa.array(rows[n], pa.string()) for n in list(rows)[4:])],
                names=[key, *rows],
            )

    for name in ("n_assign long", "n_access long", "n_hex long", "n_markov long", "base_spans string", "spans string", "clean string"):
        schema = schema.add(*name.split())
    return docs.select(key, text).mapInArrow(run, schema)


def _replaced(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: labels of random strings are drawn, those of ordinary identifiers are the whole corpus's tokens."""
    docs = documents(spark, sf_dir)
    found = scan(docs, train_from_corpus(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_markov")


def redacted(docs: DataFrame, model: MarkovPair | None, text: str = "text", size: str | None = "n_chars", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns, with ``mark`` in place of every span; ``size``, where it is there, follows a changed text."""
    schema = docs.schema

    def run(batches):
        for batch in text_slices(batches, text):
            texts = batch.column(text).to_pylist()
            clean = [s if s is None else _replaced(s, find(s, model, threshold)[1], mark) for s in texts]
            columns = []
            for field in batch.schema:
                column = batch.column(field.name)
                if field.name == text:
                    column = pa.array(clean, field.type)
                elif field.name == size:
                    column = pa.array([n if c == s else len(c) for n, c, s in zip(column.to_pylist(), clean, texts)], field.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
