"""Language identification by a mixture of languages per document.

Training: relative frequencies of hashed character trigrams per language, with additive smoothing, from at most
``MAX_TRAINING_ROWS`` documents per language (those with the smallest hash of their identifier). Counting runs in
Spark; the model is a table of 2**BITS numbers per language.

Prediction: a document is a bag of trigrams drawn from an unknown mixture of languages. Expectation-maximisation
finds the proportions. The set of languages starts with the likeliest one; another joins while it raises the log
likelihood by more than a penalty of ``PENALTY`` * log(trigrams) / 2. As the log likelihood is concave, a language
cannot raise it by more than its derivative at proportion 0; one that cannot pay the penalty is not tried. The language with the largest
proportion is the answer and its proportion the score.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any training row every text
is ``und`` with score 0; between equal proportions the language first in code point order wins; rows that
repeat are judged alike; an empty table gives an empty result. Only identifier and text enter Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
MAX_TRAINING_ROWS = 2000
# Characters of a text whose trigrams are counted at once.
CHUNK = 1 << 18
SMOOTHING = 0.5
PENALTY = 2.0
STEPS, TOLERANCE = 200, 1e-4
LETTER = re.compile(r"[^\W\d_]")


def trigram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams that touch a letter, and how often each occurs.

    Upper and lower case are the same; whatever is not a letter is a gap, and gaps in a row are one.
    """
    counts = None
    tail = " "
    for start in range(0, len(text), CHUNK):
        part = re.sub(r"[\W\d_]+", " ", tail + text[start : start + CHUNK].lower())
        if start + CHUNK >= len(text):
            part += " "
        tail = part[-2:]
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.uint64)
        if len(codes) < 3:
            continue
        mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed + codes[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(7)
        buckets = ((mixed ^ (mixed >> np.uint64(29))) & np.uint64((1 << bits) - 1)).astype(np.int64)
        found = np.bincount(buckets, minlength=1 << bits)
        counts = found if counts is None else counts + found
    if counts is None:
        return np.empty(0, np.int64), np.empty(0)
    used = np.flatnonzero(counts)
    return used, counts[used].astype(float)


@dataclass
class LanguageModel:
    languages: list[str]
    # Probability of each bucket (rows) in each language (columns).
    table: np.ndarray

    def proportions(self, text: str) -> np.ndarray:
        """The proportion of each language in a text with letters."""
        used, counts = trigram_counts(text)
        p = self.table[used]
        total = counts.sum()
        chosen = [int(np.argmax(counts @ np.log(p)))]
        share = np.array([1.0])
        mixture = p[:, chosen[0]]
        price = PENALTY * np.log(max(total, 2.0)) / 2
        while len(chosen) < len(self.languages):
            gains = (counts / mixture) @ p - total
            gains[chosen] = 0
            best = None
            for candidate in np.flatnonzero(gains > price):
                trial = p[:, chosen + [int(candidate)]]
                shares, inside = _expectation_maximisation(trial, counts, np.append(share * 0.9, 0.1))
                gain = counts @ (np.log(inside) - np.log(mixture)) - price
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, int(candidate), shares, inside
            if best is None:
                break
            chosen.append(best[1])
            share, mixture = best[2], best[3]
        out = np.zeros(len(self.languages))
        out[chosen] = share
        return out

    def judge(self, text: str | None) -> tuple[str, float, list[dict]]:
        """Language, its proportion, and all languages found with their proportions, largest first."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, []
        shares = self.proportions(text)
        order = sorted(np.flatnonzero(shares), key=lambda i: (-shares[i], i))
        found = [{"lang": self.languages[i], "share": float(shares[i])} for i in order]
        return found[0]["lang"], min(1.0, found[0]["share"]), found


def _expectation_maximisation(p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the columns of ``p`` that maximise the likelihood of ``counts``, and the mixture there."""
    total = counts.sum()
    for _ in range(STEPS):
        mixture = p @ share
        after = share * ((counts / mixture) @ p) / total
        moved = np.abs(after - share).max()
        share = after
        if moved < TOLERANCE:
            break
    return share, p @ share


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_rows: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """Learn from rows with a language and a text that are not held out, at most ``max_rows`` per language.

    The bound holds through a threshold on the identifier's hash, so no language is gathered and sorted.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        held_out(id_col).alias("held"),
    ).filter("lang is not null and text is not null and not held")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(max_rows)) / F.col("n"))
    chosen = rows.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").filter(place < F.col("share") * (1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                used, counts = trigram_counts(text)
                sums.setdefault(lang, np.zeros(1 << BITS))[used] += counts
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, bucket long, n double")
    # At most 2**BITS rows per language, and a learned language is a column of the model.
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.full((1 << BITS, len(languages)), SMOOTHING)
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        table[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return LanguageModel(languages, table / table.sum(axis=0, keepdims=True) if languages else table)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier, held_out, lang_pred, score, proportions (language and share, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, proportions array<struct<lang:string,share:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.judge(t) for t in texts], columns=["lang_pred", "score", "proportions"])

    judged = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), judge(F.col(text_col).cast("string")).alias("j"))
    return judged.select(id_col, "held_out", "j.lang_pred", "j.score", "j.proportions")
