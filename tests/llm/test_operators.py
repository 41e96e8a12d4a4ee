"""Each operator against a plain version on small fixtures with nulls, empty texts, repeated rows and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lightloom.llm.registry")
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lightloom.llm import components, decontaminate, hnsw, langid, neardup, packing, quality, secrets, tokens, toxicity, warc

RNG = np.random.default_rng(5)
VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter", "É") for b in ("na", "ru", "so", "ß") for c in ("", "x", "ing")]
BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(int(n)) for n in RNG.integers(1, 120, 40)]
    near = base[0].split()
    near[len(near) // 2] = "changed"
    return [*base, None, "", " \t\n", base[3], base[3], " ".join(near), base[5] + " tail words", "One two", "one TWO", "x" * 300 + " " + prose(30), "<|endoftext|> a  b\n\n c"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # a repeated row, a null key, and extra columns whose names the operators use themselves
    rows = [(i, t, "en", "src", 0, 1.5, "x") for i, t in enumerate(texts)] + [(3, texts[3], "en", "src", 0, 1.5, "x"), (None, "kana ru", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, word string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_tokens(spark, docs, texts):
    model = Tokenizer.from_file(BPE)
    got = tokens.count_tokens(docs, BPE, chunk=64, overlap=16).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] or "" if r.doc_id is not None else "kana ru"
        assert r.n_tokens == len(model.encode(t, add_special_tokens=False).ids)
        assert r.n_bytes == len(t.encode())
    assert tokens.count_tokens(empty(spark), BPE).count() == 0


@pytest.mark.parametrize("text", ["a" * 500, " " * 400 + "b", "ab  \n\n cd" * 80, "wort " * 200 + "<|endoftext|>" * 5, "é" * 90 + "\t" + "漢字 " * 100, "'s 're" * 100])
def test_resynchronisation(text):
    model = tokens.encoder(BPE)
    plain = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((80, 70), (100, 80), (200, 100)):
        assert model.encode_long(text, chunk, overlap) == plain


def test_packing(spark, docs, texts):
    model = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE, window=64, step=4).collect()
    by_sequence = {}
    for r in rows:
        t = texts[r.doc_id] or "" if r.doc_id is not None else "kana ru"
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = {k: len(model.encode(texts[k] or "", add_special_tokens=False).ids) + 1 for k in range(len(texts))}
    assert sum(r.length for r in rows if r.doc_id not in (None, 3)) == sum(v for k, v in total.items() if k != 3)
    assert packing.pack(empty(spark), BPE).count() == 0


def test_plan_uses_up_any_histogram():
    for h in (np.zeros(65), np.r_[0, RNG.integers(0, 50, 64)], np.r_[np.zeros(45), 1000, np.zeros(19)]):
        used = np.zeros(65, dtype=int)
        for lengths, repeats in packing.plan(h.astype(np.int64), 4):
            assert sum(lengths) <= 64
            for v in lengths:
                used[v] += repeats
        assert (used == h).all()


def test_near_duplicates(spark, docs, texts):
    got = neardup.near_duplicates(docs, words=4).collect()
    assert len(got) == len(texts) + 2

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return frozenset(zip(*(w[i:] for i in range(4)))) if len(w) >= 4 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_in_blocks(spark):
    base = prose(200).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[3 * i] = f"own{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, words=4, key_block=7, set_block=7).collect()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_decontamination(spark, docs, texts):
    items = [(1, texts[0]), (20, " ".join(texts[1].split()[:12])), (3, "one two"), (4, None), (5, "..."), (None, "kana"), (6, texts[0])]
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), size=6).collect()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    assert len(got) == len(texts) + 1
    for r in got:
        w = words(texts[r.doc_id]) if r.doc_id is not None else ["kana", "ru"]
        hit, found = set(), set()
        for item, t in items:
            b = words(t)
            if not b or item is None:
                continue
            n = min(6, len(b))
            for j in range(len(b) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add(str(item))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_without_broadcasts(spark, docs, texts, monkeypatch):
    items = [(7, " ".join(texts[0].split()[2:9])), (8, texts[5]), (9, "one two"), (9, None), (None, texts[1]), (10, "nowhere at all"), (11, texts[0])]
    asked = lambda: sorted(map(str, decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), size=6).collect()))
    before = asked()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    assert asked() == before and sum("contaminated=True" in r for r in before) > 3


def test_secrets(spark):
    key = "Zx8qLw93TnB5vRk2Yp7M"
    rows = [(1, f"password = 'hunter22' and {key}"), (2, None), (3, ""), (4, "token:abc" + " kanarusomi" * 5), (5, "a" * 30 + " AKIA" + "B" * 16), (1, f"password = 'hunter22' and {key}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = [("".join(RNG.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"), 24)), 1) for _ in range(200)] + [(f"{a}_{b}", 0) for a in VOCABULARY for b in VOCABULARY[:8]] + [(None, 1), ("x", None)]
    model = secrets.train(spark.createDataFrame(labelled, "text string, label int"))
    got = {r.doc_id: r for r in secrets.scan(df, model, redact="*").collect()}
    assert got[1].n_assign == 1 and got[1].n_markov == 1 and key not in got[1].clean and got[1].base_spans == "assign:0:20"
    assert got[2].spans == got[3].spans == "" and got[4].n_assign == 0
    assert (got[5].n_hex, got[5].n_access) == (1, 1)
    assert model.score(key) > 0.5 > model.score("kanaru_somiterna")
    assert secrets.scan(empty(spark), None).count() == 0


def test_quality_and_toxicity_held_out(spark):
    good = [(i, prose(60)) for i in range(0, 200, 2)]
    bad = [(i, " ".join(w + "$$$" for w in prose(60).split())) for i in range(1, 200, 2)]
    df = spark.createDataFrame(good + bad + [(900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(120)], "doc_id long, y int")
    rows = quality.with_features(df)
    model = quality.fit(rows, marks)
    got = {r.doc_id: r.score for r in quality.rate(rows, model).collect()}
    assert all((got[i] >= 0.3) == (i % 2 == 0) for i in range(120, 200)) and 0 <= got[900] == got[901] <= 1

    def text(i):
        w = prose(80).split()
        if i % 2:
            for j in (7, 31, 55):
                w[j] = RNG.choice(["grubbish", "snarkle", "blorpful"])
        return " ".join(w)

    df = spark.createDataFrame([(i, text(i)) for i in range(300)] + [(900, None), (901, ""), (902, "kana a grubbishh ru")], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, y int"), buckets=1 << 14)
    got = {r.doc_id: r.score for r in toxicity.rate(df, model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(i % 2) for i in range(200, 300)]) > 0.9
    assert got[902] > got[901] == got[900]
    assert toxicity.rate(empty(spark), model).count() == 0
    assert toxicity.drop_toxic(df, model).count() < df.count()


def test_toxicity_learns_from_long_texts(spark):
    def text(i, n):
        w = prose(n).split()
        if i % 2:
            w[3 :: 12] = RNG.choice(["grubbish", "snarkle", "blorpful"], len(w[3::12]))
        return " ".join(w)

    # every text is over the bound of its class
    df = spark.createDataFrame([(i, text(i, 3000)) for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    model = toxicity.learn(df.unionByName(df.limit(5)), marks, sample=((2000, 12000), (2000, 12000)), always=30, buckets=1 << 14)
    tests = spark.createDataFrame([(i, text(i, 60)) for i in range(100)], "doc_id long, text string")
    assert np.isfinite(model.at) and np.mean([(r.score >= 0.3) == bool(r.doc_id % 2) for r in toxicity.rate(tests, model).collect()]) > 0.9
    # a long text drops itself alone, and none at all of the first ones
    assert toxicity.shares(np.array([5, 9, 4, 3]), 12, 1)[1].tolist() == [0, 2, 3]
    level, chosen = toxicity.shares(np.array([1000, 2, 900, 1]), 103, 3)
    assert level == 50 and chosen.tolist() == [0, 1, 2, 3]
    cut = spark.createDataFrame([(" ".join(f"w{i}" for i in range(900)),), ("short one",)], "text string").select(toxicity.excerpt(F.col("text"), F.lit(1000)).alias("e")).collect()
    words = [int(w[1:]) for w in cut[0].e.split()]
    assert cut[1].e == "short one" and len(cut[0].e) <= 1000 and words == sorted(set(words)) and min(words) < 250 and max(words) > 650 and all(w < 900 for w in words)
    with pytest.raises(ValueError):
        toxicity.learn(df.filter("doc_id % 2 = 1"), marks)
    assert toxicity.drop_toxic(empty(spark), toxicity.learn(empty(spark), marks)).count() == 0


def test_language_mixtures(spark):
    words = {"aa": ["kana", "lopo", "mirus"], "bb": ["Zwisch", "trüg", "schaft"]}
    say = lambda lang, n: " ".join(RNG.choice(words[lang], n))
    rows = [(i, say(l, 30), l) for i, l in enumerate(["aa", "bb"] * 20)]
    langs, table = langid.train(spark.createDataFrame([*rows, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    assert langs == ["aa", "bb"]
    tests = [(1, say("aa", 5)), (2, say("bb", 5)), (3, say("aa", 30) + " " + say("bb", 12)), (4, None), (5, "12 %"), (6, "")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), langs, table).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["aa", "bb", "aa", "und", "und", "und"]
    assert 0.6 < got[3].score < 0.8 and got[1].score > 0.99 and got[4].score == 0
    assert langid.identify(empty(spark), langs, table).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = "<p>" + "héllo " * 40
    rows = [(1, "http://a/ü b", page), (2, None, page), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", page), (7, "u", page + "x"), (2, None, page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{tmp_path}/w", archives=3).cache()
    got = warc.read(manifest, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows) == sum(r.records for r in manifest.collect())
    for r in got:
        want = next(h for k, _, h in rows if k == r.page_id) or ""
        assert r.payload_bytes == len(want.encode()) and r.payload_digest == hashlib.sha256(want.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id == 2 else ("response", None))
        assert r.payload == (None if r.page_id == 2 else want)
    assert warc.write(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_nearest(spark):
    x = RNG.standard_normal((600, 16))
    x[7] = x[8] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (None, [1.0] * 16), (5, x[5].tolist()), (2000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, df.filter("vec_id % 10 = 0 or vec_id in (7, 2000)")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, rows in got.items():
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len({v for _, v, _ in rows} & set(best))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in rows) and len(rows) == 5
    assert 1000 not in got and 2000 not in got and hits >= 0.95 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[7])][:2] == [8, 9]
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rows = [(i, prose(60), "en", "s", 0) for i in range(40)]
    item = " ".join(rows[9][1].split()[5:25])
    rows += [(50, rows[2][1], "en", "s", 0), (51, "password=abcdef123 " + prose(20), "en", "s", 0), (52, None, None, None, None), (53, "", "en", "s", 0), (2, rows[2][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*range(40), 51, 52, 53} - {9}
    assert len([r for r in got if r.doc_id == 2 and r.start == 0]) == 1


@pytest.mark.parametrize("key_block, set_block", [(20000, 4000), (20000, 9), (5, 4)])
def test_near_duplicates_of_chains(spark, key_block, set_block):
    # texts that share half of their words with the next one, near copies of them, and one group of many near copies
    words = prose(4000).split()
    texts = [" ".join(words[i * 30 : i * 30 + 60]) + f" own{i}" for i in range(40)]
    texts += [t.replace(t.split()[5], "else", 1) for t in texts[::3]]
    base = prose(150).split()
    texts += [" ".join([*base[: 3 * i], f"new{i}", *base[3 * i + 1 :]]) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4, key_block=key_block, set_block=set_block)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(root))


def test_hot_keys_are_split(spark, monkeypatch):
    from lightloom import components as shared

    monkeypatch.setattr(shared, "LEAST", 10)
    left = spark.createDataFrame([(0, i) for i in range(300)] + [(i, i) for i in range(1, 50)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 2)
    got = shared.join_hot(left, right, ["k"], ["v"], 349, 300)
    assert sorted((r.k, r.v, r.n, r.w) for r in got.collect()) == sorted([(0, i, 300, 0) for i in range(300)] + [(i, i, 1, 2 * i) for i in range(1, 50)])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_over_many_shards(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 6000)] + 0.4 * rng.standard_normal((6000, 24))).astype(np.float32).astype(float)
    x[100:1300] = x[100]  # a fifth of all rows hold one vector
    x[1300:1303] = [f * x[1300] for f in ((2, 4, 16) if kind == "float" else (3, 7, 10))]  # equal directions
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(5)
    queries = df.filter("vec_id % 50 = 0 or vec_id in (1300, 1301)")
    nodes = hnsw.distinct_vectors(hnsw.usable(df, "vec_id", "embedding"), 6)
    cells, _ = hnsw.fit_cells(nodes, 5, 200)
    assert len(cells[24].centroids) > 20 and cells[24].visits < 12 and nodes.count() == 4801
    got = {}
    for r in hnsw.nearest(df, queries, cell_size=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, rows in got.items():
        s = np.round(u @ u[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(6000), -s))[:5]
        rows.sort()
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5] and all(abs((u[v] @ u[q]) - score) < 1e-9 and score <= 1 for _, v, score in rows)
        hits += len({v for _, v, _ in rows} & set(best.tolist()))
    assert len(got) == queries.count() and hits >= 0.95 * 5 * len(got)
    assert [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104] and [v for _, v, _ in got[1301]][:2] == [1300, 1302]
