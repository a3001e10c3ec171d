from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from biospark.llm import mixing
from biospark.llm.mixing import MixOptions
from tests.llm.conftest import prose, table

SMALL = MixOptions(block_words=8, shard_slots=32)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def reshared(sizes, weights, ceiling=3):
    """Targets by sharing the excess again until none is above."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        above = [s for s in free if share[s] > ceiling * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: float(ceiling * sizes[s]) for s in above}


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, prose(i, 20 + 7 * (i % 13)), "en", ["a", "b", "c", "d", None][min(4, i % 9)]) for i in range(160)]
    rows += [(1000, prose(1, 9000), "en", "d"), (1001, None, "en", "b"), (1002, "", None, "tiny"), (1003, "five words are in here", "en", "tiny")]
    return rows


def test_targets_and_counts(spark, corpus):
    got = mixing.mix_report(table(spark, corpus), SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert len(got) == len(corpus)
    assert got["size"].tolist() == [len(words(r[1])) for r in sorted(corpus)]
    assert (got["taken"] <= 3 * got["size"]).all()
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = reshared(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    source = {r[0]: r[3] for r in corpus}
    taken = defaultdict(int)
    for row in got.itertuples():
        assert row.target == pytest.approx(targets[source[row.doc_id]])
        assert row.source_size == sizes[source[row.doc_id]]
        taken[source[row.doc_id]] += row.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) < max(10 * SMALL.block_words, 0.02 * target)


def test_reruns_agree(spark, corpus):
    docs = table(spark, corpus)
    a, b = (mixing.mix_report(d, SMALL).orderBy("doc_id").collect() for d in (docs, docs.repartition(5, "doc_id")))
    assert a == b


def test_spans_and_texts_agree_with_the_report(spark, corpus):
    docs = table(spark, corpus)
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs, SMALL).collect()}
    sized, spans = mixing.mixed_spans(docs, SMALL)
    spans = spans.join(sized, "rid").collect()
    counted = Counter()
    for s in spans:
        counted[s["doc_id"]] += s["to_word"] - s["from_word"]
    assert {k: v for k, v in report.items() if v} == dict(counted)
    # No word twice in a pass, and no pass beyond the third.
    seen = Counter((s["doc_id"], s["epoch"], w) for s in spans for w in range(s["from_word"], s["to_word"]))
    assert set(seen.values()) == {1} and {s["epoch"] for s in spans} <= {0, 1, 2}
    slots = Counter((s["shard"], s["slot"]) for s in spans)
    assert max(s for _, s in slots) < 32
    out = mixing.mixed_documents(docs, SMALL)
    assert out.columns == docs.columns
    mixed, original = Counter(), {r[0]: words(r[1]) for r in corpus}
    for r in out.collect():
        mixed[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        rest = iter(original[r["doc_id"]])
        assert all(w in rest for w in words(r["text"]))
    assert mixed == counted


def test_permutation(spark):
    for size in (1, 2, 7, 64, 1000):
        df = spark.range(size).withColumn("size", F.lit(size).cast("long"))
        image = df.select(mixing.permuted(F.col("id"), F.col("size"), F.lit(42), F.lit(3)).alias("p")).collect()
        assert sorted(r["p"] for r in image) == list(range(size))
    assert [r["p"] for r in image] != list(range(1000))


def test_odd_rows(odd, odd_rows):
    got = mixing.mix_report(odd, SMALL).collect()
    assert len(got) == len(odd_rows)
    assert sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in odd_rows)
    assert mixing.mixed_documents(odd, SMALL).columns == odd.columns


def test_nothing_to_take(spark, nothing):
    assert mixing.mix_report(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
    got = mixing.mix_report(table(spark, [(1, None), (2, " ")])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0)] * 2
