"""Phrase collocations from weighted acyclic automata.

1. A shard (a few megabytes of the texts of one language, in one task) counts its n-grams of words and builds a count
   transducer from them in sorted order: an acyclic automaton over words whose states carry weights, so that the weight of
   the state that an n-gram leads to is its count. States with equal weights and equal arcs are one state: new ones are
   looked up in a register, a run of first words at a time. No n-gram leaves a task in any other form.
2. Each shard tells some of its n-grams at even distances; they give the bounds of prefix ranges of about equal size. Ranges
   are between n-grams and not between first words, so that what follows a very common word or pair is dealt to many ranges.
   Shards are cut at the bounds, the slices of a range meet in a task, and their union adds up weights.
3. Candidates are read off the unions. Their parts are looked up by composition: each part, once for all candidates that
   have it, goes to the range that holds it, and is followed through that range's transducer to its weight.
4. Scores, the rule of longer candidates and the ranks are joins and groupings of candidates. All arithmetic is in whole
   numbers, of up to 38 digits.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, mix, runs, text_slices, utf8
from .components import join_hot
from .neardup import grouped

#: Bytes of text in a shard, n-grams of full length in a prefix range, those from one mark of a shard to the next, and the
#: number of marks that bounds are taken from (so also the most ranges: beyond 131,072 of them, ranges grow).
SHARD, RANGE, STRIDE, MARKS = 8 << 20, 1 << 20, 4096, 1 << 17
#: First words are added to a transducer in runs of about so many n-grams.
RUN = 1 << 19
_SPACE, _HARD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE[[9, 32]] = True
_HARD[[*b".,;:!?", *range(10, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, ends): all lower-cased words of some texts, and which of them end a piece."""
    text, a, b = runs(~(_SPACE | _HARD)[data], offs)
    hard = np.cumsum(_HARD[data])
    ends = np.ones(len(a), dtype=bool)
    if len(a):
        ends[:-1] = (text[1:] != text[:-1]) | (hard[a[1:]] != hard[a[:-1]])
    inside = _LOWER[data[~(_SPACE | _HARD)[data]]]
    at = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(inside.tobytes())]), ends


def expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of some runs, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def counted(ids: np.ndarray, ends: np.ndarray, size: int, most: int) -> list:
    """[(parent, label, weight)]: the n-grams of 1 to ``most`` words as levels of a trie, each sorted; parent is the place
    of an n-gram's first words in the level before. ids: words as numbers below ``size``."""
    levels, code, open_ = [], ids, np.ones(len(ids), dtype=bool)
    parent_of = np.zeros(len(ids), dtype=np.int64)
    for n in range(most):
        if n:
            open_ = open_[:-1] & ~ends[n - 1 : -1] if len(open_) else open_
            code = parent_of[:-1] * size + ids[n:] if len(parent_of) else code
        found, inverse, weight = np.unique(code[open_], return_inverse=True, return_counts=True)
        levels.append((found // size if n else np.zeros(len(found), dtype=np.int64), found % size if size else found, weight.astype(np.int64)))
        parent_of = np.zeros(len(code), dtype=np.int64)
        parent_of[open_] = inverse
    return levels


def union(parts: list, size: int) -> list:
    """The trie of all n-grams of several, weights added up; labels are numbers below ``size`` in all of them."""
    out, at = [], [np.zeros(1, dtype=np.int64)] * len(parts)
    for n in range(len(parts[0])):
        code = np.concatenate([at[i][p[n][0]] * size + p[n][1] for i, p in enumerate(parts)])
        found, inverse = np.unique(code, return_inverse=True)
        weight = np.zeros(len(found), dtype=np.int64)
        begin = 0
        for i, p in enumerate(parts):
            stop = begin + len(p[n][1])
            at[i] = inverse[begin:stop]
            weight[at[i]] += p[n][2]  # places differ within a part
            begin = stop
        out.append((found // size, found % size, weight))
    return out


class Transducer:
    """States by depth, each with a weight and arcs (word, state of the next depth), built from sorted runs of first words."""

    def __init__(self, words: pa.Array, most: int):
        self.words, self.most = words, most
        self.weight = [np.zeros(0, dtype=np.int64) for _ in range(most)]
        self.arcs = [np.zeros(0, dtype=np.int64) for _ in range(most)]  # how many a state has
        self.label = [np.zeros(0, dtype=np.int64) for _ in range(most)]
        self.target = [np.zeros(0, dtype=np.int64) for _ in range(most)]
        self.root = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.register = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)) for _ in range(most)]

    @classmethod
    def build(cls, words: pa.Array, levels: list) -> Transducer:
        self = cls(words, len(levels))
        total = np.searchsorted(levels[1][0], np.arange(len(levels[0][1]) + 1)) if self.most > 1 else np.arange(len(levels[0][1]) + 1)
        edges = [0, *(np.flatnonzero(np.diff(total[1:] // RUN)) + 1).tolist(), len(levels[0][1])]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                self.add(within(levels, [(a, b)])[0])
        self.register = []
        return self

    def add(self, levels: list) -> None:
        """More n-grams: all those of some first words, which are larger than the ones before."""
        below = None
        for d in range(self.most - 1, -1, -1):
            _, label, weight = levels[d]
            n = len(label)
            one, two = mix(weight.astype(np.uint64) + np.uint64(1)), mix(weight.astype(np.uint64) ^ np.uint64(0x5DEECE66D1234567))
            first = np.zeros(n + 1, dtype=np.int64)
            if d + 1 < self.most:
                first = np.searchsorted(levels[d + 1][0], np.arange(n + 1))
                word, to = levels[d + 1][1].astype(np.uint64), below.astype(np.uint64)
                for kind, arc in ((one, mix(mix(word + np.uint64(3)) ^ to)), (two, mix(mix(word ^ np.uint64(0x9E3779B97F4A7C15)) + to))):
                    reach = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(arc, dtype=np.uint64)])
                    kind += reach[first[1:]] - reach[first[:-1]]
            key, pick, inverse = np.unique(one, return_index=True, return_inverse=True)
            if (two[pick][inverse] != two).any():  # different states of one hash: each stays a state of its own
                key, pick, inverse = one, np.arange(n), np.arange(n)
            known, other, ids = self.register[d]
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            hit = (known[at] == key) & (other[at] == two[pick]) if len(known) else np.zeros(len(key), dtype=bool)
            state = np.zeros(len(key), dtype=np.int64)
            state[hit] = ids[at[hit]] if len(known) else 0
            new = pick[~hit]
            state[~hit] = len(self.weight[d]) + np.arange(len(new))
            self.weight[d] = np.concatenate([self.weight[d], weight[new]])
            count = first[new + 1] - first[new]
            self.arcs[d] = np.concatenate([self.arcs[d], count])
            if d + 1 < self.most:
                of = expanded(first[new], count)
                self.label[d] = np.concatenate([self.label[d], levels[d + 1][1][of]])
                self.target[d] = np.concatenate([self.target[d], below[of]])
            merged = np.concatenate([known, key[~hit]])
            order = np.argsort(merged, kind="stable")
            self.register[d] = merged[order], np.concatenate([other, two[new]])[order], np.concatenate([ids, state[~hit]])[order]
            below = state[inverse]
        self.root = np.concatenate([self.root[0], levels[0][1]]), np.concatenate([self.root[1], below])

    def levels(self) -> list:
        """All paths, as ``counted`` gives them."""
        out, (label, state) = [], self.root
        parent = np.zeros(len(label), dtype=np.int64)
        for d in range(self.most):
            out.append((parent, label, self.weight[d][state]))
            if d + 1 < self.most:
                first = np.cumsum(self.arcs[d]) - self.arcs[d]
                count = self.arcs[d][state]
                of = expanded(first[state], count)
                parent, label, state = np.repeat(np.arange(len(state)), count), self.label[d][of], self.target[d][of]
        return out

    def compose(self, paths: np.ndarray) -> np.ndarray:
        """Weights of some paths [row, word] at once, words as numbers, -1 after a path's end and -2 for unknown words; 0 where a path leads nowhere."""
        size = len(self.words) + 1
        state = np.zeros(len(paths), dtype=np.int64)
        out = np.zeros(len(paths), dtype=np.int64)
        alive = np.ones(len(paths), dtype=bool)
        for d in range(min(self.most, paths.shape[1])):
            if d == 0:
                key, to = self.root
            else:
                key, to = np.repeat(np.arange(len(self.arcs[d - 1])), self.arcs[d - 1]) * size + self.label[d - 1], self.target[d - 1]
            word = paths[:, d]
            alive &= word != -1
            wanted = state * size * (d > 0) + word
            at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
            alive &= (key[at] == wanted) & (word >= 0) if len(key) else False
            state = np.where(alive, to[at] if len(key) else 0, 0)
            last = alive & ((paths[:, d + 1] == -1) if d + 1 < paths.shape[1] else True)
            out[last] = self.weight[d][state[last]]
        return out

    def pack(self) -> bytes:
        size = np.asarray(pc.binary_length(self.words)).astype(np.int64)
        data = np.frombuffer(b"".join(self.words.to_pylist()), dtype=np.uint8)
        arrays = [size, data, *self.root, *self.weight, *self.arcs, *self.label, *self.target]
        head = np.array([self.most, *(len(a) for a in arrays)], dtype="<i8")
        narrow = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in arrays]
        kinds = bytes(a.dtype.itemsize for a in narrow)
        return zstandard.compress(len(head).to_bytes(4, "little") + head.tobytes() + kinds + b"".join(a.tobytes() for a in narrow), 1)

    @classmethod
    def unpack(cls, raw: bytes) -> Transducer:
        raw = zstandard.decompress(raw)
        n = int.from_bytes(raw[:4], "little")
        head = np.frombuffer(raw, dtype="<i8", count=n, offset=4)
        at = 4 + 8 * n
        kinds, at = raw[at : at + n - 1], at + n - 1
        arrays = []
        for kind, length in zip(kinds, head[1:].tolist()):
            arrays.append(np.frombuffer(raw, dtype=f"<u{kind}", count=length, offset=at))
            at += kind * length
        most, data = int(head[0]), arrays[1]
        arrays = [a.astype(np.int64) for a in [arrays[0], *arrays[2:]]]
        offs = np.concatenate([[0], np.cumsum(arrays[0])]).astype(np.int32)
        self = cls(pa.Array.from_buffers(pa.binary(), len(arrays[0]), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())]), most)
        self.root, rest = (arrays[1], arrays[2]), arrays[3:]
        self.weight, self.arcs, self.label, self.target = (rest[i * most : (i + 1) * most] for i in range(4))
        return self


def within(levels: list, spans: list) -> list:
    """Tries of the n-grams at some spans of first words."""
    out = []
    for a, b in spans:
        part = []
        for n, (parent, label, weight) in enumerate(levels):
            if n:
                shift = a
                a, b = np.searchsorted(parent, [a, b]).tolist()
            part.append(((parent[a:b] - shift) if n else parent[a:b], label[a:b], weight[a:b]))
        out.append(part)
    return out


def places(levels: list, words: list, bound: tuple) -> list[int]:
    """How many n-grams of each level come before ``bound``, a tuple of words (an n-gram comes before its continuations)."""
    from bisect import bisect_left

    out, begin, stop, exact = [], 0, len(levels[0][1]), True
    for n, (parent, label, _) in enumerate(levels):
        if n:
            begin, stop = np.searchsorted(parent, [at, at + exact]).tolist()
        if not exact or n >= len(bound):
            at, exact = begin, False
            out.append(begin)
            continue
        rank = bisect_left(words, bound[n])
        at = begin + int(np.searchsorted(label[begin:stop], rank))
        exact = at < stop and rank < len(words) and words[rank] == bound[n] and int(label[at]) == rank
        out.append(at + (exact and n + 1 < len(bound)))
    return out


def slices(machine: Transducer, lang: bytes, bounds: list) -> list:
    """[(range, transducer)] of a shard: the n-grams between bounds (lang, words ...); what a slice needs of the n-grams
    before it, as their beginning, has weight 0 there."""
    levels, words = machine.levels(), machine.words.to_pylist()
    first, last = bisect_right(bounds, (lang,)), bisect_right(bounds, (lang, b"\xff" * 4))  # no word is larger: UTF-8 has no byte 0xff
    cuts = [[0] * len(levels), *(places(levels, words, b[1:]) for b in bounds[first:last]), [len(x[1]) for x in levels]]
    out = []
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if lo == hi:
            continue
        begin, stop = list(lo), list(hi)
        for n in range(len(levels) - 2, -1, -1):
            below = levels[n + 1][0][begin[n + 1] : stop[n + 1]]
            if len(below):
                begin[n], stop[n] = min(begin[n], int(below[0])), max(stop[n], int(below[-1]) + 1)
        part = []
        for n, (parent, label, weight) in enumerate(levels):
            a, b = begin[n], stop[n]
            own = np.arange(a, b)
            part.append((parent[a:b] - (begin[n - 1] if n else 0), label[a:b], np.where((own >= lo[n]) & (own < hi[n]), weight[a:b], 0)))
        used = np.unique(np.concatenate([x[1] for x in part]))
        part = [(p, np.searchsorted(used, label), w) for p, label, w in part]
        out.append((first + i, Transducer.build(machine.words.take(pa.array(used)), part)))
    return out


def merged(machines: list) -> Transducer:
    """The union of some transducers."""
    words = pc.unique(pa.concat_arrays([m.words for m in machines]))
    words = words.take(pc.array_sort_indices(words))
    parts = []
    for m in machines:
        to = np.asarray(pc.index_in(m.words, value_set=words)).astype(np.int64)
        parts.append([(parent, to[label], weight) for parent, label, weight in m.levels()])
    return Transducer.build(words, union(parts, max(1, len(words))))


def shards(docs: DataFrame, most: int, text: str, lang: str, size: int) -> DataFrame:
    """(lang, n_words, n_grams, marks, machine): a row for each shard."""

    def shard(lang: str, held: list) -> tuple:
        words, ends = pa.concat_arrays([w for w, _ in held]), np.concatenate([e for _, e in held])
        found = words.dictionary_encode()
        order = np.asarray(pc.array_sort_indices(found.dictionary))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        vocabulary = found.dictionary.take(pa.array(order))
        levels = counted(rank[np.asarray(found.indices)], ends, len(order), most)
        longest = [len(x[1]) for x in levels]
        depth = max((n for n in range(most) if longest[n]), default=0)
        at = np.arange(STRIDE // 2, longest[depth], STRIDE)
        marks = [[] for _ in at]
        for n in range(depth, -1, -1):
            for m, word in zip(marks, vocabulary.take(pa.array(levels[n][1][at])).to_pylist()):
                m.insert(0, word.decode())
            at = levels[n][0][at]
        return lang, len(words), longest[depth], marks, Transducer.build(vocabulary, levels).pack()

    def rows(found: list) -> pa.RecordBatch:
        names = {"lang": pa.string(), "n_words": pa.int64(), "n_grams": pa.int64(), "marks": pa.list_(pa.list_(pa.string())), "machine": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), names.values())], names=list(names))

    def run(batches):
        held: dict = {}
        sizes: dict = {}
        for batch in text_slices(batches, "text"):
            batch = batch.take(pc.sort_indices(batch.column("lang")))
            names = np.asarray(batch.column("lang"))
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                data, offs = utf8(batch.column("text").slice(a, b - a))
                held.setdefault(names[a], []).append(words_of(data, offs))
                sizes[names[a]] = sizes.get(names[a], 0) + len(data) + 1
            full = list(sizes) if sum(sizes.values()) > 2 * size else [x for x, s in sizes.items() if s > size]
            for name in full:
                sizes.pop(name)
                yield rows([shard(name, held.pop(name))])
        for name in list(held):
            yield rows([shard(name, held.pop(name))])

    chosen = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "lang string, n_words long, n_grams long, marks array<array<string>>, machine binary")


def unions(parts: DataFrame, bounds: list, ranges: int) -> DataFrame:
    """(range, lang, machine): each prefix range's transducer, from those of all shards."""
    shared = parts.sparkSession.sparkContext.broadcast(bounds)

    def split(batches):
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("machine").to_pylist()):
                for at, machine in slices(Transducer.unpack(raw), lang.encode(), shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([lang]), pa.array([machine.pack()], pa.binary())], names=["range", "lang", "machine"])

    def meet(batches):
        for group in grouped(batches, "range", "lang"):
            held, total = [], 0
            for raw in group.column("machine"):
                held.append(Transducer.unpack(raw.as_py()))
                total += raw.as_buffer().size
                if total > 8 << 20 and len(held) > 1:
                    held, total = [merged(held)], 0
            whole = merged(held) if len(held) > 1 else held[0]
            yield pa.RecordBatch.from_arrays([group.column("range")[:1].combine_chunks(), group.column("lang")[:1].combine_chunks(), pa.array([whole.pack()], pa.binary())], names=["range", "lang", "machine"])

    schema = "range int, lang string, machine binary"
    dealt = parts.select("lang", "machine").mapInArrow(split, schema)
    return dealt.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "lang").mapInArrow(meet, schema)


def frequent(machines: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, a): n-grams of at least two words with at least this weight."""

    def run(batches):
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("machine").to_pylist()):
                machine = Transducer.unpack(raw)
                levels = machine.levels()
                for n in range(1, len(levels)):
                    at = np.flatnonzero(levels[n][2] >= least)
                    a, columns = levels[n][2][at], []
                    for k in range(n, -1, -1):
                        columns.insert(0, machine.words.take(pa.array(levels[k][1][at])))
                        at = levels[k][0][at]
                    phrase = pc.binary_join_element_wise(*columns, b" ").cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), phrase, pa.array(np.full(len(a), n + 1, dtype=np.int32)), pa.array(a)], names=["lang", "phrase", "size", "a"])

    return machines.mapInArrow(run, "lang string, phrase string, size int, a long")


def looked_up(machines: DataFrame, parts: DataFrame, bounds: list, most: int, ranges: int) -> DataFrame:
    """(lang, part, n, f): the weight of each part (lang, part, n), a phrase of words with a space between them."""
    shared = parts.sparkSession.sparkContext.broadcast(bounds)

    def place(batches):
        for batch in batches:
            at = [bisect_right(shared.value, (lang.encode(), *part.encode().split(b" "))) for lang, part in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(left.column("lang").to_pylist(), left.column("machine")))
        lang = right.column("lang").to_pylist()
        weight = np.zeros(len(lang), dtype=np.int64)
        for name in set(lang) & set(found):
            machine = Transducer.unpack(found[name].as_py())
            at = np.flatnonzero(np.array([x == name for x in lang]))
            words = [p.encode().split(b" ") for p in right.column("part").take(pa.array(at)).to_pylist()]
            flat = pa.array([w for p in words for w in p], pa.binary())
            code = np.asarray(pc.fill_null(pc.index_in(flat, value_set=machine.words), -2)).astype(np.int64)
            count = np.array([len(p) for p in words])
            paths = np.full((len(words), most), -1, dtype=np.int64)
            paths[np.repeat(np.arange(len(words)), count), expanded(np.zeros(len(count), dtype=np.int64), count)] = code
            weight[at] = machine.compose(paths)
        return pa.table({"lang": right.column("lang"), "part": right.column("part"), "n": right.column("n"), "f": pa.array(weight)})

    asked = parts.mapInArrow(place, "range int, lang string, part string, n long").repartitionById(ranges, F.col("range"))
    return machines.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(run, "lang string, part string, n long, f long")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, percent: int = 50, scale: int = 1_000_000, text: str = "text", lang: str = "lang", shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most`` words.

    A-Z are lower-cased; pieces end at .,;:!? and line breaks, words at spaces and tabs. Phrases that occur ``least`` times
    or more within pieces are candidates. Cut in two, with counts l and r, a candidate scores floor(scale * a * a / (l * r));
    its lowest cut counts, the first of equal ones. Candidates within a longer one that occurs at least ``percent`` % as
    often are dropped. Ties go to larger a, then to the smaller phrase in the order of its bytes. n is the number of all
    words of the language. Null texts are empty; a null language is ``und``; repeated rows count as often as they stand
    there; no texts give no rows. Other columns are not read. Counts up to 10**15 are exact.
    """
    parts = cut(shards(docs, most, text, lang, shard))
    total = parts.agg(F.coalesce(F.sum("n_grams"), F.lit(0))).first()[0]
    marks = parts.select("lang", F.explode("marks").alias("mark")).orderBy(F.xxhash64("lang", "mark"), "lang", "mark").limit(MARKS).collect()
    marks = sorted((r["lang"].encode(), *(w.encode() for w in r["mark"])) for r in marks)
    count = min(len(marks) + 1, max(1, -(-total // RANGE)))
    bounds = sorted({marks[i * len(marks) // count] for i in range(1, count)})
    ranges = len(bounds) + 1
    machines = cut(unions(parts, bounds, ranges))
    candidates = cut(frequent(machines, least))
    words = F.split("phrase", " ")
    # the largest count of a longer candidate that holds a phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (F.lit(100).cast("decimal(38,0)") * F.col("over") < F.lit(percent).cast("decimal(38,0)") * F.col("a")))
    kept = cut(kept.select("lang", "phrase", "size", "a"))
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("left"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("left"), F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("part")),
    )))
    halves = kept.select("lang", "phrase", "a", F.inline(sides))
    answers = cut(looked_up(machines, halves.groupBy("lang", "part").agg(F.count("*").alias("n")), bounds, most, ranges))
    rows, largest = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    found = join_hot(halves, answers, ["lang", "part"], ["phrase"], rows, largest)
    at = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).cast("decimal(19,0)")
    cuts = found.groupBy("lang", "phrase", "a").agg(*[at(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, most) for left in (True, False)])
    score = lambda k: F.expr(f"(cast({scale} as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (l{k} * r{k})")
    each = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").cast("long").alias("l"), F.col(f"r{k}").cast("long").alias("r"))) for k in range(1, most)])
    scored = cuts.select("lang", "phrase", "a", F.array_min(F.filter(each, lambda c: c.isNotNull())).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    sizes = parts.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, phrases of two and three words; see ``collocations`` for nulls, ties and repeated rows."""
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS f FROM (
  SELECT lang, 1 AS m, w[i] AS phrase FROM g
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM g WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM g WHERE i + 2 <= len(w)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
o AS (SELECT lang, phrase, max(a) AS over FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE m = 3) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE o.over IS NULL OR 100 * o.over < 50 * c.a),
s AS (SELECT lang, phrase, a, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM k UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM k WHERE m = 3),
t AS (SELECT s.lang, s.phrase, s.a, s.k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * s.a * s.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM s JOIN f x ON x.lang = s.lang AND x.phrase = s.lp JOIN f y ON y.lang = s.lang AND y.phrase = s.rp),
b AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM t) WHERE q = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
