"""Where the toxicity model is trained."""

import os

import numpy as np

from lightloom.llm import toxicity


def test_a_task_trains_not_the_driver(spark, monkeypatch):
    plain = toxicity.train

    def told(*args, **shape):
        model = plain(*args, **shape)
        model.pid, model.texts = os.getpid(), args[0]
        return model

    monkeypatch.setattr(toxicity, "train", told)
    rows = [(i, " ".join(["kana lopo mirus"] * (3 + i % 5) + ["grubbish snarkle"] * (i % 2) + [f"w{i % 11}"])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, y int")
    model = toxicity.learn(docs, marks, buckets=1 << 12)
    assert model.pid != os.getpid()
    # the same model as trained here on the same texts
    of = dict((t, i % 2) for i, t in rows)
    here = plain(model.texts, np.array([of[t] for t in model.texts]), buckets=1 << 12)
    assert len(model.texts) == 80 and model.at == here.at and np.array_equal(model.embed, here.embed)
