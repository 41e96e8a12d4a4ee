"""Rows that share a key, rows without one, and texts that are full of secrets."""

import time

import pytest

pytest.importorskip("lightloom.llm.registry")
import corpus_pipeline
from lightloom.llm import neardup, secrets

TEXT = " ".join(f"word{i} follows{i % 7} here{i % 11}" for i in range(60))
OTHER = " ".join(f"quite{i} different{i % 5} words{i % 3}" for i in range(60))
COLUMNS = "doc_id long, text string, lang string, copy long, first string, own int"


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, "en", 1, "f", 2) for r in rows], COLUMNS).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3])
def test_one_key_with_different_texts(spark, parts):
    rows = [(1, TEXT), (2, TEXT + " x"), (2, OTHER), (2, TEXT + " y"), (3, OTHER.upper()), (4, TEXT), (4, TEXT)]
    for order in (rows, rows[::-1]):
        got = neardup.near_duplicates(frame(spark, order, parts), words=4).join(frame(spark, rows, 1).selectExpr("xxhash64(text) as copy", "text").distinct(), "copy").collect()
        assert sorted((r.doc_id, r.text, r.component_id, r.kept, r["first"]) for r in got) == sorted(
            [(1, TEXT, 1, True, True), (2, TEXT + " x", 1, False, False), (2, OTHER, 2, True, True), (2, TEXT + " y", 1, False, False), (3, OTHER.upper(), 2, False, False), (4, TEXT, 1, False, False), (4, TEXT, 1, False, False)]
        )
        left = corpus_pipeline.drop_near_duplicates(spark, frame(spark, order, parts), "").collect()
        assert sorted((r.doc_id, r.text) for r in left) == [(1, TEXT), (2, OTHER)]


def test_two_texts_of_one_key_that_are_alike(spark):
    rows = [(5, TEXT), (5, TEXT + " x"), (6, "short"), (6, "Short")]
    got = neardup.near_duplicates(frame(spark, rows, 2), words=4).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and sum(r["first"] for r in got) == 2
    assert corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows, 2), "").count() == 2


@pytest.mark.parametrize("more", [[], [(7, OTHER), (7, OTHER)]])
def test_null_keys_whatever_else_repeats(spark, more):
    rows = [(None, TEXT), (None, TEXT), (None, None), (None, None), (8, "some other text"), *more]
    left = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows, 3), "").collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str(r) for r in {*rows})
    found = neardup.near_duplicates(frame(spark, [*rows, (9, TEXT + " x")], 3), words=4)
    assert {(r.doc_id, r.component_id, r.kept) for r in found.collect() if r.n_shingles > 100 and r.doc_id != 7} == {(None, 9, False), (9, 9, True)}


def test_a_text_of_many_keys():
    line = "0123456789abcdef01234567 AbCdEfGhIjKlMnOpQrStUvWx\n"
    text = line * 100_000
    model = secrets.MarkovPair(secrets.bigrams(secrets.random_strings(50)), secrets.bigrams(["identifier", "some_name", "other"] * 50))
    start = time.time()
    base, every = secrets.find(text, model, -1e9)
    assert time.time() - start < 60 and len(base) == 100_000 and len(every) == 200_000
    assert every[:2] == [(0, 24, "hex"), (25, 49, "markov")]
    # a token within a longer span of a rule, behind a shorter one that starts later
    base, every = secrets.find("password=AbCdEfGhIjKlMnOpQrStUvWx.0123456789abcdef01234567.ZzYyXxWwVvUuTtSsRr", model, -1e9)
    assert every == base
