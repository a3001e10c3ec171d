from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from biospark.llm import langid
from biospark.llm.words import documents
from tests.conftest import SMALL
from tests.llm.conftest import table

EN = "the quick brown fox jumps over the lazy dog and the house with that thing where they wish to go "
DE = "der schnelle braune fuchs springt nicht über den faulen hund und das haus mit dem ding wohin sie gehen "
FR = "le renard brun saute par dessus le chien paresseux et la maison avec cette chose où ils veulent aller "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t * (1 + i % 3), lang) for i in range(60) for t, lang in ((EN, "en"), (DE, "de"), (FR, "fr"))]
    return langid.fit(table(spark, [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]))


def test_mixtures(model):
    assert model.languages == ["de", "en", "fr"]
    lang, score, found = model.judge(EN * 6 + DE * 3)
    assert lang == "en" and {f["lang"] for f in found} == {"en", "de"}
    assert abs(score - 2 / 3) < 0.1 and sum(f["share"] for f in found) == pytest.approx(1)
    assert model.judge(FR)[:2] == ("fr", 1.0)
    assert [f["lang"] for f in model.judge(EN * 3 + DE * 3 + FR * 3)[2]].__len__() == 3


def test_likelihood_of_the_mixture_is_the_highest(model):
    used, counts = langid.trigram_counts(EN * 5 + DE * 3)
    p = model.table[used][:, :2]
    share, _ = langid._expectation_maximisation(p, counts, np.array([0.5, 0.5]))
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([counts @ np.log(p @ np.array([g, 1 - g])) for g in grid])]
    assert abs(share[0] - best) < 0.01


def test_chunks_count_like_the_whole(monkeypatch):
    text = EN + "12 -- " + DE
    whole = langid.trigram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 17)
    again = langid.trigram_counts(text)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()


def test_odd_rows(spark, odd, odd_rows, model):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= got and langid.predict(odd, model).count() == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in langid.predict(odd, model).collect())


def test_held_out_rows_are_not_learned(spark):
    rows = [(i, EN, "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i in range(80)]
    assert langid.fit(table(spark, rows)).languages == ["en"]
    flags = {r["doc_id"]: r["held_out"] for r in langid.predict(table(spark, rows), langid.fit(table(spark, rows))).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(80)}


def test_without_training_rows(spark, nothing):
    model = langid.fit(nothing)
    assert [tuple(r)[2:4] for r in langid.predict(table(spark, [(1, EN)]), model).collect()] == [("und", 0.0)]
    assert langid.predict(nothing, model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_accuracy_on_held_out_documents(spark):
    docs = documents(spark, SMALL.replace("0.001", "0.01"))
    judged = langid.predict(docs, langid.fit(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(judged) > 150 and (judged["lang"] == judged["lang_pred"]).mean() > 0.97
