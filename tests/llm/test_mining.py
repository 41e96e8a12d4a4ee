"""Collocations, license scans and centroid clusters against plain versions, over nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

pytest.importorskip("lightloom.llm.registry")
from lightloom.llm import bisector, collocations, licenses, registry
from lightloom.llm.common import utf8

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n long, a long, t int, label string, range int, phrase string"
MORE = ("s", 1, 2, 3, "l", 4, "p")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, *MORE) for i, t, lang in rows], DOCUMENTS).repartition(parts)


# collocations


def grams(texts, most=3) -> Counter:
    found = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)]
            for n in range(1, most + 1):
                found.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return found


def machine(texts):
    words, ends = collocations.words_of(*utf8(pa.array(texts, pa.string())))
    found = words.dictionary_encode()
    order = np.asarray(pc.array_sort_indices(found.dictionary))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return collocations.Transducer.build(found.dictionary.take(pa.array(order)), collocations.counted(rank[np.asarray(found.indices)], ends, len(order), 3))


def read(machine) -> Counter:
    found, words, before = Counter(), machine.words.to_pylist(), [()]
    for n, (parent, label, weight) in enumerate(machine.levels()):
        before = [(before[p] if n else ()) + (words[x],) for p, x in zip(parent, label)]
        found.update({g: int(w) for g, w in zip(before, weight) if w})
    return found


def some_texts(rng, most=40):
    words = ["a", "b", "Bb", "é", "c_d", "zz", "q\x00"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randrange(most))) for _ in range(rng.randrange(4))] + [""]


@pytest.mark.parametrize("run", [40, 1 << 19])
def test_transducers(monkeypatch, run):
    monkeypatch.setattr(collocations, "RUN", run)
    rng = random.Random(run)
    for _ in range(60):
        sets = [some_texts(rng) for _ in range(3)]
        machines = [machine(s) for s in sets]
        for m, s in zip(machines, sets):
            assert read(collocations.Transducer.unpack(m.pack())) == grams(s)
        whole = sum((grams(s) for s in sets), Counter())
        assert read(collocations.merged(machines)) == whole
        bounds = sorted({(b"en", *rng.choice(sorted(whole))) for _ in range(4)} | {(b"aa", b"x"), (b"zz",)}) if whole else []
        ranges: dict = {}
        for m in machines:
            for at, part in collocations.slices(m, b"en", bounds):
                ranges.setdefault(at, []).append(part)
        dealt = Counter()
        for at, parts in ranges.items():
            m = collocations.merged(parts)
            own, words = read(m), m.words.to_pylist()
            assert all(bisect_right(bounds, (b"en", *g)) == at for g in own)
            dealt.update(own)
            asked = [*own, (b"nope",), (b"a", b"nope"), (b"nope", b"a")]
            paths = np.array([[words.index(w) if w in words else -2 for w in g] + [-1] * (3 - len(g)) for g in asked])
            assert m.compose(paths).tolist() == [own[g] for g in asked]
        assert dealt == whole


def test_equal_states_are_shared():
    m = machine([". ".join(f"w{i} x y" for i in range(200))])
    assert len(m.weight[0]) == 3 and len(m.weight[1]) <= 3 and len(m.weight[2]) == 1


def plain_collocations(rows, top, least=10):
    out = {}
    for lang in {r[2] or "und" for r in rows}:
        f = grams([t for _, t, own in rows if (own or "und") == lang])
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            longer = [x for h, x in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * x >= 50 * a for x in longer):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, b" ".join(g), f[g[:k]], f[g[k:]]))
        n = sum(v for g, v in f.items() if len(g) == 1)
        for rank, (score, a, g, left, right) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank] = (g.decode(), -a, left, right, n, -score)
    return out


@pytest.mark.parametrize("shard, stride", [(1 << 23, 4096), (200, 3)])
def test_collocations(spark, monkeypatch, shard, stride):
    monkeypatch.setattr(collocations, "STRIDE", stride)
    monkeypatch.setattr(collocations, "RANGE", 40 if stride == 3 else 1 << 20)
    rng = random.Random(2)
    words = ["the", "of", "Red", "tape", "ému", "zz", "new", "york", "city"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", ", ", "\n", " new york city "]) for _ in range(n))
    rows = [(i, say(rng.randrange(60)), rng.choice(["en", "en", "en", "de", None])) for i in range(90)]
    rows += [(3, rows[3][1], rows[3][2]), (None, say(30), "en"), (95, None, "en"), (96, "", "xx"), (97, " .\n", "yy"), (98, "one two " * 40, "lonely"), (99, say(3000), "en")]
    for top in (2000, 7):
        got = collocations.collocations(frame(spark, rows), top=top, shard=shard).collect()
        assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == plain_collocations(rows, top)
        assert len(got) == len({(r.lang, r["rank"]) for r in got})


def test_no_collocations(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "", "en"), (3, "a b", "en")])).count() == 0


# licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_base(text):
    words, out = words_of(text), []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out), len(words)


LICENSED = [
    (1, "All rights reserved. ALL-RIGHTS\nreserved, all rights", "reserved"),
    (2, "This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    (3, "x Licensed under the Apache License, Version 2.0 y " * 3, "apache-2.0"),
    (4, "released under the MIT license", "mit"),
    (5, "Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    (6, "cc by cc by cc by", "cc-by"),
    (7, "under the license of the rights reserved general public", ""),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this new software and associated documentation files, the software, to deal in it without restriction", "mit"),
    (9, "permission is hereby granted free", ""),
    (10, None, ""),
    (11, "", ""),
    (12, "cc", ""),
    (13, "é cc\x00by Ünder", "cc-by"),
    (None, "all rights reserved", "reserved"),
    (14, "kana " * 50000 + "all rights reserved " + "ru " * 50000, "reserved"),
    (15, "all rights reserved " * 4000, "reserved"),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_licenses(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(licenses, "BROADCAST_WORDS", 0)
    rows = [(i, t, "en") for i, t, _ in LICENSED]
    got = licenses.scan(frame(spark, [*rows, rows[0]])).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in LICENSED)  # a repeated row is one document
    for r in got:
        text, labels = {i: (t, x) for i, t, x in LICENSED}[r.doc_id]
        found, n = plain_base(text)
        places = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and r.labels == labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_diagonals_with_a_word_put_in(spark):
    text = "one two three four five six seven eight nine ten"
    template = (licenses.Template("t", text, 3, 0.6, 2),)
    docs = [(1, text.replace("six", "six extra"), "en"), (2, text.replace("six ", ""), "en"), (3, "one two three " + "filler " * 40 + "eight nine ten", "en"), (4, f"{text} and {text}", "en")]
    got = licenses.spans(frame(spark, docs), template).filter("t is not null").orderBy("doc_id", "first").collect()
    assert [(r.doc_id, r.first, r["last"], r.covered) for r in got] == [(1, 0, 11, 10), (2, 0, 9, 9), (4, 0, 10, 10), (4, 11, 21, 10)]


def test_no_licenses(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
    plan = licenses.scan(frame(spark, [(1, "all rights reserved", "en")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# clusters


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(np.float64(256) * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, c, d in out:
        per[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda d: d if d < 2**63 else None  # noqa: E731  what a long can't hold is null, and so are sums with it
    lost = {c for _, c, d in out if d >= 2**63}
    return sorted(((i, c, fits(d), None if c in lost else fits(per[c]), None if lost else fits(sum(per.values())), name[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 4e5, 3e6])
def test_clusters(spark, tmp_path, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(64) * scale).astype(np.float32).tolist()) for i in range(90)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (300, None), (301, [1.0] * 63), (302, [1.0] * 63 + [None]), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, [0.0] * 64), (306, [0.0] * 64)]
    spark.createDataFrame([(*r, 0, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label int, cluster int, distance double").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["op13_bisector_clusters"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows)


def test_sign_tests_give_ties_to_smaller_numbers():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-2, 3, (12, 3)).tolist()
    x = rng.integers(-3, 4, (500, 3))
    best, distance = bisector.Tournament(centroids).winners(x)
    full = ((x[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    for value in (0, -1, 2**40, -(2**40), 2**40 - 1, 3**60, -(3**60)):
        assert sum(v << (bisector.LIMB * i) for i, v in enumerate(bisector.limbs(value))) == value


def test_no_clusters(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.queries()["op13_bisector_clusters"](spark, str(tmp_path)).count() == 0
