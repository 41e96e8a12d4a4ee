"""The registered corpus queries by name, over tables with nulls, repeated rows, a very long text and clashing columns,
over empty ones, and with labels that nothing can be learned from."""

import hashlib
import re
import zlib

import numpy as np
import pytest

registry = pytest.importorskip("lightloom.llm.registry")
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lightloom.llm import secrets, toxicity

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "so", "ra") for b in ("na", "ru", "sol", "vet", "ing")]
SLURS = ["grubbish", "snarkle", "blorpful"]
#: Columns of the contract; the query may have more.
COLUMNS = {
    "op1_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op8_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, key string, id long, n long, y int, h long, features string, label string, copy string"


def texts():
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    out = {}
    for i in range(240):
        words = say(60).split()
        if i % 3 == 1:
            for at in (7, 22, 40):
                words[at] = SLURS[int(rng.integers(3))]
        if i % 4 == 2:
            words = [w + "$$$" for w in words]
        out[i] = " ".join(words)
    random = lambda n: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"), n))
    planted = {i: random(24) for i in range(300, 320)}
    out |= {i: f"{say(20)} {key} {say(20)}" for i, key in planted.items()}
    out |= {400: None, 401: "", 402: " \n", 403: f'Password: "{random(9)}" AKIA{"Q" * 18} {"0af3" * 8}', 404: out[3], 405: out[6] + " kana"}
    out[500] = say(700_000)  # 4 MB
    return out, planted


def write(spark, folder, docs, labels, pages=(), vectors=(), items=()):
    more = [1.5, "w", "k", 1, 2, 3, 4, "f", "l", "c"]
    rows = [(i, t, None if i is None else ("aa", "bb")[i % 2], "s", 0, *more) for i, t in docs]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string, digest string, size long").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int, id long, v string, dim int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(list(items), "item_id string, text string, win string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, _ = texts()
    rows = [*docs.items(), (3, docs[3]), (None, "kana ru " * 20)]
    labels = [(i, int(i % 4 != 2), int(i % 3 == 1), "x") for i in range(240)] + [(1, None, None, None), (None, 1, 1, None), (5, 1, 0, "x")]
    page = "<p>" + "hé " * 60
    pages = [(1, "http://a/b", page, "d", 1), (2, None, page, None, None), (3, "u", None, None, None), (4, "u", "tiny", None, None), (5, "u", "tiny", None, None), (2, None, page, None, None)]
    rng = np.random.default_rng(2)
    vectors = [(i, rng.standard_normal(8).tolist(), 1, i, "v", 0) for i in range(120)] + [(200, None, 0, 0, None, 0), (250, [0.0] * 8, 0, 0, None, 0), (None, [1.0] * 8, 0, 0, None, 0)]
    items = [("q1", " ".join(docs[9].split()[5:20])), ("q2", None), ("q3", "..."), (None, "kana"), ("q1", " ".join(docs[9].split()[5:20]))]
    folder = write(spark, tmp_path_factory.mktemp("tables") / "t", rows, labels, pages, vectors, [(*x, "w") for x in items])
    return folder, rows


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, tables, name):
    folder, rows = tables
    found = registry.queries()[name](spark, folder)
    assert {k: v for k, v in found.dtypes if k in COLUMNS[name]} == COLUMNS[name]
    got = found.collect()
    if name.startswith(("op2", "op3", "op5", "op6", "op7", "op9")):
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    CHECKS.get(name, lambda *_: None)(got, dict(rows[:-1]))


def check_secrets(got, docs):
    rules = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24)]
    _, planted = texts()
    hits = 0
    for r in got:
        if r.doc_id is None:
            continue
        text = docs[r.doc_id] or ""
        spans = [(m.start(), j, m.end(), kind) for j, (kind, rule, flags, group, least) in enumerate(rules) for m in re.finditer(rule, text, flags) if len(m[group]) >= least]
        listed = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        added = [s for s in every if s not in listed]
        assert sorted(every) == sorted(listed + added) and len(added) == r.n_markov
        if r.doc_id in planted:
            at = text.index(planted[r.doc_id])
            hits += added == [f"markov:{at}:{at + 24}"]
        elif r.doc_id < 300:
            assert not added  # clean texts are left alone
    assert hits == len(planted)


def check_held_out(modulus, left, truth, least):
    def check(got, docs):
        right = []
        for r in got:
            assert r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == left)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
            if r.held_out and r.doc_id < 240:
                right.append(r.predicted == truth(r.doc_id))
        assert len(right) > 30 and np.mean(right) >= least

    return check


def check_near(got, docs):
    by = {r.doc_id: r for r in got}
    assert by[404].component_id == 3 and not by[404].kept and by[405].component_id == 6 and by[3].kept
    assert by[400].n_shingles == by[401].n_shingles == by[402].n_shingles == 0 and by[400].kept
    words = docs[500].split()
    assert by[500].n_shingles == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)})


def check_tokens(got, docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        if r.doc_id is not None:
            t = docs[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(model.encode(t, add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 1024)


def check_packing(got, docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in docs.items()}
    sequences, total = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        if r.doc_id is not None:
            own = ids[r.doc_id]
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert all(total[i] == len(own) * (2 if i == 3 else 1) for i, own in ids.items())
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and {r.padded for r in parts} == {at if at & (at - 1) == 0 else 1024}


def check_benchmark(got, docs):
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + 1 and {i for i, r in by.items() if r.contaminated} == {9} and by[9].n_hit == 15 and by[9].n_items == 1
    assert by[500].n_words == 700_000 and by[9].items_sha256 == hashlib.sha256(b"q1").hexdigest()


def check_language(got, docs):
    assert {r.lang_pred for r in got if r.doc_id in (400, 401, 402)} == {"und"}
    assert all(r.lang_pred in ("aa", "bb", "und") and 0 <= r.score <= 1 for r in got)


def check_pages(got, docs):
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None)]


def check_vectors(got, docs):
    assert sorted({r.query_id for r in got}) == [0, 50, 100] and len(got) == 15 and all(r.vec_id < 120 and r.vec_id != r.query_id for r in got)


CHECKS = {
    "op1_nearest_neighbours": check_vectors,
    "op2_secret_scan": check_secrets,
    "op3_quality": check_held_out(5, 0, lambda i: int(i % 4 != 2), 0.95),
    "op4_decontamination": check_benchmark,
    "op5_near_duplicates": check_near,
    "op6_toxicity": check_held_out(4, 2, lambda i: int(i % 3 == 1), 0.9),
    "op7_token_counts": check_tokens,
    "op8_warc": check_pages,
    "op9_language_id": check_language,
    "op10_packing": check_packing,
}


def test_pipeline_by_stage(spark, tables):
    folder, rows = tables
    text = dict(rows[:-1])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.learn(docs.filter(toxicity.fold("doc_id", 4) != 2), spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(240)], "doc_id long, y int"))
    scored = {r.doc_id for r in toxicity.rate(docs, model).collect() if r.score < 0.3}
    kept = stages["toxicity"](spark, docs, folder)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == scored and kept.columns == docs.columns
    assert np.mean([(i in scored) == (i % 3 != 1) for i in range(240)]) > 0.9 and {300, 400, 401, 500, None} <= scored
    near = stages["near_duplicates"](spark, docs, folder)
    assert near.columns == docs.columns and sorted(str(r.doc_id) for r in near.select("doc_id").collect()) == sorted(str(i) for i in [*text, None] if i not in (404, 405))
    clean = stages["decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and clean.filter("doc_id = 9").count() == 0 and clean.count() == docs.count() - 1
    redacted = stages["secrets"](spark, docs, folder)
    assert redacted.columns == docs.columns
    changed = {r.doc_id: r.text for r in redacted.collect() if r.doc_id is not None and r.text != text[r.doc_id]}
    _, planted = texts()
    assert set(changed) == {*planted, 403} and all(changed[i] == text[i].replace(key, "[SECRET]") for i, key in planted.items()) and "AKIA" not in changed[403]


@pytest.mark.parametrize("name", [*COLUMNS, "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    assert registry.queries()[name](spark, write(spark, tmp_path / "t", [], [])).count() == 0


@pytest.mark.parametrize("labels", [[], [(i, 1, 1, None) for i in range(60)], [(i, 0, 0, None) for i in range(60)], [(i, None, 7, None) for i in range(9)]])
def test_labels_that_teach_nothing(spark, tmp_path, labels):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(WORDS, 40))) for i in range(60)] + [(70, None), (71, "")]
    folder = write(spark, tmp_path / "t", docs, labels)
    for name in ("op3_quality", "op6_toxicity"):
        got = registry.queries()[name](spark, folder).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got}) == 1
    assert all(r.predicted == 0 for r in got)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {i for i, _ in docs}


def test_rules_find_longest_runs():
    assert secrets.base_spans("AKIA" + "A" * 15) == [] and len(secrets.base_spans("AKIA" + "A" * 16)) == 1
