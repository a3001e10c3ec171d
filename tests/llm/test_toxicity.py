from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest

from biospark.llm import toxicity
from biospark.llm.words import documents
from tests.conftest import SMALL
from tests.llm.conftest import prose, table

INSULTS = ["numbskull", "blockhead", "dimwit"]


def insulted(seed, insults=INSULTS):
    rng = random.Random(seed)
    words = prose(seed, 60).split(" ")
    for _ in range(4):
        words.insert(rng.randrange(len(words)), rng.choice(insults))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    texts = [insulted(i) for i in range(80)] + [prose(1000 + i, 60) for i in range(240)]
    return toxicity.train(texts, [1] * 80 + [0] * 240)


def test_insults_and_disguised_insults(model):
    scorer = toxicity.Scorer(model)
    assert scorer.score([insulted(5000 + i) for i in range(20)]).min() > 0.5
    assert scorer.score([prose(6000 + i, 80) for i in range(20)]).max() < 0.3
    for disguised in (["num-bskull", "b.l.o.c.k.h.e.a.d", "d i m w i t"], ["numbsxkull", "blockyhead", "dimwwit"]):
        assert scorer.score([insulted(7000 + i, disguised) for i in range(10)]).min() > 0.3


def test_features_are_the_normalised_kernel():
    def brute(word):
        word, out = f"^{word}$", {}
        for i in range(len(word)):
            for b in range(2, toxicity.SPAN):
                for a in range(1, b):
                    if i + b < len(word):
                        u = word[i] + word[i + a] + word[i + b]
                        out[u] = out.get(u, 0) + toxicity.DECAY ** (b + 1)
        return out

    words = ["banana", "band", "a", "bandanas", "ünïts"]
    kernel = toxicity._landmark_kernel(words, words)
    vectors = [brute(w) for w in words]
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            dot = sum(v * y.get(u, 0) for u, v in x.items())
            norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert kernel[i, j] == pytest.approx(dot / norm, abs=1e-3)


def test_decision_is_the_support_vector_machine_on_landmarks():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(200, 3)), np.ones(200)]
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0)
    w = toxicity._svm(x, y, np.ones(200), ridge=0.1)
    slack = np.maximum(0, 1 - y * (x @ w))
    gradient = 0.1 * w - x.T @ (y * slack)
    assert np.abs(gradient).max() < 1e-6


def test_long_words_and_texts(model, monkeypatch):
    # A long word is read in windows, and no window is left out.
    pieces = toxicity.pieces_of("x" * 100 + "numbskull" + "y" * 100)
    assert max(map(len, pieces)) <= toxicity.WINDOW and any("numbskull" in p for p in pieces)
    assert model.decisions(["numbskull" * 12])[0] > -1
    scorer = toxicity.Scorer(model)
    whole = scorer.features([insulted(1) * 30])
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    assert np.allclose(toxicity.Scorer(model).features([insulted(1) * 30]), whole, atol=0.05)


def test_remembering_does_not_change_scores(model, monkeypatch):
    texts = [insulted(i) for i in range(10)] + [prose(i, 50) for i in range(10)]
    expected = toxicity.Scorer(model).score(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    assert (toxicity.Scorer(model).score(texts) == expected).all()


def test_odd_rows(odd, odd_rows, model):
    got = toxicity.predict(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_labels_that_repeat_contradict_or_miss(spark, nothing):
    docs = table(spark, [(i, insulted(i) if i % 3 == 0 else prose(i, 50)) for i in range(60)])
    rows = [(i, 0, int(i % 3 == 0)) for i in range(60)] + [(0, 0, 0), (3, 0, None), (None, 0, 1), (999, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels).logistic.any()
    none = toxicity.fit(docs, labels.filter("toxic is null"))
    assert [r["score"] for r in toxicity.predict(docs, none).collect()] == pytest.approx([0.0] * 60, abs=1e-9)
    assert toxicity.predict(nothing, toxicity.fit(nothing, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_accuracy_on_held_out_documents(spark):
    folder = SMALL.replace("0.001", "0.1")
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    judged = toxicity.predict(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in judged["doc_id"])
    toxic = judged["toxic"] == 1
    assert (judged["predicted"][toxic] == 1).mean() > 0.9 and (judged["predicted"][~toxic] == 1).mean() < 0.02
