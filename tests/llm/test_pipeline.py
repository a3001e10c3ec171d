from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from biospark.llm import bpe, simhash, toxicity
from biospark.llm.words import documents
from tests.conftest import SMALL
from tests.llm.test_simhash import brute_components

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
FOLDER = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def results(spark):
    """The input and the result of every stage, as pandas."""
    from biospark.session import stage

    docs, out = documents(spark, FOLDER), []
    for name, step in corpus_pipeline.STAGES:
        result = stage(step(spark, docs, FOLDER))
        out.append((name, docs.toPandas(), result.toPandas()))
        docs = result
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(results):
    assert [n for n, _, _ in results] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mix", "bpe"]
    columns = list(results[0][1].columns)
    assert all(list(after.columns) == columns for _, _, after in results[:-1])


def test_toxic_documents_go(spark, results):
    _, before, after = results[0]
    docs = documents(spark, FOLDER)
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = toxicity.Scorer(model).score(before["text"].tolist())
    assert sorted(before["doc_id"][scores < 0.3]) == sorted(after["doc_id"])


def test_copies_go(results):
    _, before, after = results[1]
    assert sorted(after["doc_id"]) == sorted(before.groupby("text")["doc_id"].max())


def test_near_copies_go(results):
    _, before, after = results[2]
    prints = [simhash.fingerprint(t) % (1 << 64) for t in before["text"]]
    label = brute_components(prints, 2)
    least = {}
    for i, key in enumerate(before["doc_id"]):
        least[label[i]] = min(least.get(label[i], key), key)
    assert sorted(after["doc_id"]) == sorted(least.values())


def test_mix_takes_words_in_order(results):
    _, before, after = results[3]
    texts = dict(zip(before["doc_id"], before["text"]))
    total = Counter()
    for row in after.itertuples():
        rest = iter(words(texts[row.doc_id]))
        assert all(w in rest for w in words(row.text))
        total[row.doc_id] += len(words(row.text))
    assert all(n <= 3 * len(words(texts[d])) for d, n in total.items())
    assert abs(sum(total.values()) / sum(len(words(t)) for t in before["text"]) - 1) < 0.02


def test_encoding(results):
    _, before, after = results[4]
    coder = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
    expected = Counter()
    for row in before.itertuples():
        ids = np.array(coder.encode_ordinary(row.text), "<u4")
        expected[(row.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(row.text.encode()).hexdigest())] += 1
    assert Counter(zip(after["doc_id"], after["n_tokens"], after["ids_sha256"], after["decoded_sha256"])) == expected


def test_odd_and_empty_tables(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SMALL)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()
