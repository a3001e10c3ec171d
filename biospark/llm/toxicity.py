"""Toxicity by a support vector machine over a gapped subsequence kernel.

Kernel: two words are similar when they share subsequences of ``ORDER`` characters; an occurrence that spans s
characters counts ``DECAY`` ** s, spans over ``SPAN`` count nothing, and the kernel is normalised. Gaps absorb inserted,
dropped and replaced characters. Characters that are not letters are left out of a word, and three or more
single letters in a row are read as one word, so "i-d.i o t" spellings meet the kernel too.

Nystroem: with landmarks l_1..l_m the kernel is replaced by the inner product of K(x, l) K(l, l)^(-1/2). A squared hinge
support vector machine is trained there. Its decision is linear in K(x, l), so it is stored as one weight per (hashed)
subsequence and a word is scored without comparing it with any landmark.

Training on labelled sentences: different sentences take the label of their document. In a toxic sentence one word is to blame, at
first the one with the highest odds of toxic documents, later the one with the highest decision; the words of clean
sentences are the other class, the hardest ones included after each round. A logistic regression turns a
document's highest decision, its words over the margin and their share into a probability; it is fitted to documents
whose words were not learned, weighted to the classes' real shares. The sample is
bounded: about ``MAX_TRAINING_ROWS`` labelled documents per class (those with the smallest hash of their identifier).

Defined cases: null and empty texts, and texts without a letter, get the score of a document without any suspect word; without a
training row of both classes every score is the share of toxic labels (0 without labels); rows that repeat are
judged alike; a label that is repeated or contradicted counts as toxic if any row says so; an empty table gives an
empty result. Only the text column enters Python when scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.llm.langid import held_out

ORDER, SPAN, DECAY = 3, 6, 0.6
BITS = 18
LANDMARKS = 256
MAX_TRAINING_ROWS = 3000
ROUNDS = 3
# Clean words of each kind (frequent, random, hard) in training, and the log odds that a word to blame must have.
FREQUENT, LEAST_ODDS = 3000, 1.0
# Toxic (and clean) documents that the probability must be fitted to.
LEAST_CALIBRATION = 15
# Copies with an inserted letter that a word to blame is trained with.
VARIANTS = 2
THRESHOLD = 0.3
# Longest word that is one string for the kernel; longer ones are read in windows of PIECE letters, STEP apart.
WINDOW, PIECE, STEP = 24, 12, 4
# Words whose decisions a worker remembers in each of two generations.
REMEMBERED = 300_000
# Characters of a text that are split into words at once, and words whose decisions are looked up together.
CHUNK, GROUP_WORDS = 1 << 20, 100_000
SENTENCE_END = re.compile(r"[.!?\n]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
GAP = re.compile(r"\s")

# Offsets of the second and third character after the first.
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def letters(word: str) -> str:
    return NOT_LETTERS.sub("", word)


def words_in(text: str) -> Iterator[list[str]]:
    """Lower-case words of a text in lists of bounded size; single letters in a row also as one word."""
    start = 0
    while start < len(text):
        cut = GAP.search(text, start + CHUNK) if len(text) - start > CHUNK else None
        end = cut.start() if cut else len(text)
        words = text[start:end].lower().split()
        if words:
            yield words + _spelled(words)
        start = end


def _spelled(words: list[str]) -> list[str]:
    """Words that are spelled with gaps between their letters."""
    out, run = [], []
    for i in [i for i, w in enumerate(words) if len(w) <= 2]:
        single = letters(words[i])
        if len(single) != 1:
            continue
        if run and run[-1][0] != i - 1:
            if len(run) > 2:
                out.append("".join(c for _, c in run))
            run = []
        run.append((i, single))
    if len(run) > 2:
        out.append("".join(c for _, c in run))
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised feature vectors of the words: word position, hashed subsequence, value; a word's entries are
    next to each other."""
    by_size: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_size.setdefault(len(word) + 2, []).append(i)
    weight = DECAY ** (np.arange(8) + 1.0)
    rows, features, values = [], [], []
    for size, at in by_size.items():
        joined = "".join([f"^{words[i]}$" for i in at])
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(at), size)
        first, second, third = (codes * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
        keys = []
        for a, b in PATTERNS:
            if (n := size - b) > 0:
                mixed = first[:, :n] + (second[:, a : a + n] ^ (third[:, b:] >> np.uint32(3)))
                mixed ^= mixed >> np.uint32(15)
                # The lowest three bits hold the span.
                keys.append(((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS) << np.uint32(3)) | np.uint32(b))
        if not keys:
            continue
        # Sorting brings the occurrences of a subsequence in a word together.
        packed = np.sort(np.concatenate(keys, axis=1), axis=1)
        feature = packed >> np.uint32(3)
        starts = np.ones(packed.shape, bool)
        starts[:, 1:] = feature[:, 1:] != feature[:, :-1]
        begin = np.flatnonzero(starts.ravel())
        value = np.add.reduceat(weight[packed & np.uint32(7)].ravel(), begin)
        local = begin // packed.shape[1]
        norm = np.sqrt(np.bincount(local, value * value, minlength=len(at)))
        rows.append(np.array(at)[local])
        features.append(feature.ravel()[begin].astype(np.int64))
        values.append(value / norm[local])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(features), np.concatenate(values)


def pieces_of(word: str) -> list[str]:
    """A word's letters, in overlapping windows where they are many."""
    own = letters(word)
    if len(own) <= WINDOW:
        return [own] if own else []
    return [own[i : i + PIECE] for i in range(0, len(own) - PIECE + STEP, STEP)]


@dataclass
class ToxicityModel:
    # Per subsequence bucket; decision = weights . features + offset.
    weights: np.ndarray
    offset: float
    # Coefficients of the document features, the last one constant.
    logistic: np.ndarray

    def decisions(self, words: list[str]) -> np.ndarray:
        """The decision for each word; -1 for a word without a letter."""
        parts, owner = [], []
        for i, word in enumerate(words):
            for piece in pieces_of(word):
                parts.append(piece)
                owner.append(i)
        out = np.full(len(words), -1.0)
        for start in range(0, len(parts), 20_000):
            some = parts[start : start + 20_000]
            row, feature, value = subsequences(some)
            scores = np.bincount(row, value * self.weights[feature], minlength=len(some)) + self.offset
            np.maximum.at(out, np.array(owner[start : start + 20_000]), scores)
        return out


class Scorer:
    """Scores texts and remembers words' decisions, at most twice ``REMEMBERED`` of them."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        missing = []
        for word in words.difference(self.new):
            known = self.old.get(word)
            if known is None:
                missing.append(word)
            else:
                self.new[word] = known
        if missing:
            self.new.update(zip(missing, self.model.decisions(missing).tolist()))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: highest decision, logarithm of the words above 0, and of their number per 100 words, and 1."""
        top, hits, total = np.full(len(texts), -1.0), np.zeros(len(texts)), np.zeros(len(texts))
        for some in self._groups(texts):
            self._learn(set().union(*[words for _, words in some]))
            for i, words in some:
                scores = np.fromiter(map(self.new.__getitem__, words), float, len(words))
                top[i], hits[i], total[i] = max(top[i], scores.max()), hits[i] + (scores > 0).sum(), total[i] + len(words)
        rate = 100.0 * hits / np.maximum(total, 1)
        return np.c_[top, np.log1p(hits), np.log1p(rate), np.ones(len(texts))]

    def _groups(self, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """(text's position, words) in groups of bounded size, so that many new words are scored together."""
        some, size = [], 0
        for i, text in enumerate(texts):
            for words in words_in(text or ""):
                some.append((i, words))
                size += len(words)
                if size >= GROUP_WORDS:
                    yield some
                    some, size = [], 0
        if some:
            yield some

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.features(texts) @ self.model.logistic
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared hinge loss, minimised by Newton steps over the active set; the last column of x is constant."""
    active, w = np.ones(len(y), bool), np.zeros(x.shape[1])
    for _ in range(30):
        xa, wa = x[active], weight[active]
        gram = (xa * wa[:, None]).T @ xa + ridge * np.eye(x.shape[1])
        w = np.linalg.solve(gram, (xa * wa[:, None]).T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + keep
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _disguised(word: str, rng: np.random.Generator) -> str:
    """The word with one letter put in."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + chr(ord("a") + int(rng.integers(26))) + word[at:]


def _landmark_kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    row, feature, value = subsequences(landmarks)
    used, place = np.unique(feature, return_inverse=True)
    table = np.zeros((len(used) + 1, len(landmarks)))
    table[place, row] = value
    index = np.full(1 << BITS, len(used))
    index[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)))
    for start in range(0, len(words), 1000):
        some = words[start : start + 1000]
        row, feature, value = subsequences(some)
        shared = index[feature] < len(used)
        row, feature, value = row[shared], feature[shared], value[shared]
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[start + row[first]] = np.add.reduceat(table[index[feature]] * value[:, None], first)
    return out


def train(texts: list[str], toxic: list[int], class_weight: tuple[float, float] = (1.0, 1.0), seed: int = 42) -> ToxicityModel:
    """Learn from labelled documents in random order, in memory; ``fit`` bounds their number.

    Words are learned from the first two thirds of each class, the probability from the rest, whose words the support vector
    machine has not seen; from all where the rest has fewer than LEAST_CALIBRATION toxic documents. ``class_weight``:
    how many clean and how many toxic documents one of the sample stands for.
    """
    y = np.array(toxic, float)
    weight = np.where(y > 0, class_weight[1], class_weight[0])
    if len(set(toxic)) < 2:
        return _constant(y, weight)
    place = np.where(y > 0, np.cumsum(y) / y.sum(), np.cumsum(1 - y) / (len(y) - y.sum()))
    rest = place > 2 / 3
    if y[rest].sum() < LEAST_CALIBRATION or (1 - y)[rest].sum() < LEAST_CALIBRATION:
        rest = np.ones(len(y), bool)
        learned = rest
    else:
        learned = ~rest
    model = _learn_words([t for t, k in zip(texts, learned) if k], y[learned], seed)
    if model is None:
        return _constant(y, weight)
    features = Scorer(model).features([t for t, k in zip(texts, rest) if k])
    model.logistic = _logistic(features, y[rest], weight[rest] / weight[rest].mean())
    return model


def _sentences(texts: list[str], known: dict[str, list[str]]) -> list[list[str]]:
    """The words (as kernel strings) of every different sentence; copies of documents do not count again."""
    found: dict[str, None] = {}
    for text in dict.fromkeys(texts):
        found.update(dict.fromkeys(s.strip().lower() for s in SENTENCE_END.split(text or "")))
    out = []
    for sentence in found:
        words = sentence.split()
        for w in words:
            if w not in known:
                known[w] = pieces_of(w)
        if pieces := {p for w in words for p in known[w]}:
            out.append(sorted(pieces))
    return out


def _learn_words(texts: list[str], y: np.ndarray, seed: int) -> ToxicityModel | None:
    """The support vector machine; None if no word is to blame."""
    rng = np.random.default_rng(seed)
    known: dict[str, list[str]] = {}
    toxic, other = (_sentences([t for t, label in zip(texts, y) if label == k], known) for k in (1, 0))
    in_toxic, in_other = (Counter(w for pieces in group for w in pieces) for group in (toxic, other))
    odds = {
        w: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((in_other[w] + 0.5) / (len(other) + 1)) for w, n in in_toxic.items()
    }
    # Words of clean sentences: the frequent ones and a random choice.
    clean = sorted(in_other)
    negatives = {w for w, _ in in_other.most_common(FREQUENT)} | {clean[i] for i in rng.permutation(len(clean))[:FREQUENT]}
    # A word is evidence if several different toxic sentences have it and clean ones hardly do.
    decision = {w: o + np.log(in_toxic[w]) - 3 for w, o in odds.items() if in_toxic[w] > 1}
    model = None
    for _ in range(ROUNDS):
        blamed: Counter = Counter()
        for pieces in toxic:
            best = max(pieces, key=lambda w: (decision.get(w, -9.0), w))
            if decision.get(best, -9.0) > 0 and odds[best] > LEAST_ODDS and in_toxic[best] > 1:
                blamed[best] += 1
        if not blamed:
            break
        positives = [w for w, _ in blamed.most_common(FREQUENT)]
        negatives = sorted(set(negatives) - set(blamed))
        often = sorted(negatives, key=lambda w: (-in_other[w], w))
        marks = positives[: LANDMARKS // 2]
        chosen = [negatives[i] for i in rng.permutation(len(negatives))]
        marks = list(dict.fromkeys(marks + often[: LANDMARKS // 4] + chosen))[:LANDMARKS]
        values, vectors = np.linalg.eigh(_landmark_kernel(marks, marks))
        usable = values > 1e-3 * values.max()
        root = vectors[:, usable] / np.sqrt(values[usable])
        disguised = [(_disguised(w, rng), 0.5 * blamed[w]) for w in positives if len(w) > 4 for _ in range(VARIANTS)]
        words = positives + [v for v, _ in disguised] + negatives
        x = np.c_[_landmark_kernel(words, marks) @ root, np.ones(len(words))]
        sign = np.r_[np.ones(len(words) - len(negatives)), -np.ones(len(negatives))]
        # Words weigh by the root of the sentences they stand for.
        stands = [blamed[w] for w in positives] + [n for _, n in disguised] + [max(1, in_other[w]) for w in negatives]
        w = _svm(x, sign, np.sqrt(stands))
        weights = np.zeros(1 << BITS)
        row, feature, value = subsequences(marks)
        np.add.at(weights, feature, (root @ w[:-1])[row] * value)
        model = ToxicityModel(weights, float(w[-1]), np.zeros(4))
        # The next round blames by the new decisions and learns from the clean words that came too close.
        seen = sorted(in_toxic)
        decision = dict(zip(seen, model.decisions(seen)))
        scored = model.decisions(clean)
        hard = np.flatnonzero(scored > -0.5)
        hard = hard[np.argsort(-scored[hard], kind="stable")][:FREQUENT]
        negatives = set(negatives) | {clean[i] for i in hard if odds.get(clean[i], -9.0) < LEAST_ODDS}
    return model


def _constant(y: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Every score is the share of toxic labels (0 without labels)."""
    share = min(max(float(y @ weight / weight.sum()) if len(y) else 0.0, 1e-13), 1 - 1e-13)
    return ToxicityModel(np.zeros(1 << BITS), -1.0, np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = MAX_TRAINING_ROWS,
) -> ToxicityModel:
    """Train on documents with a label that are not held out, about ``max_rows`` of each class at most."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter("toxic is not null and id is not null")
        .filter(~held_out("id"))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    limit = F.lit(0)
    for label, n in sizes.items():
        limit = F.when(F.col("toxic") == label, F.lit(int((1 << 30) * min(1.0, max_rows / n)))).otherwise(limit)
    # About max_rows rows per class, so the join needs no shuffle of the texts.
    chosen = F.broadcast(known.filter(place < limit))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    sample = rows.filter("text is not null").withColumn("place", F.xxhash64("id")).toPandas()
    sample = sample.sort_values(["place", "id", "text"])
    toxic = (sample["toxic"] > 0).astype(int)
    counts = {k: sum(n for label, n in sizes.items() if (label > 0) == bool(k)) for k in (0, 1)}
    stands_for = tuple(counts[k] / max(1, (toxic == k).sum()) for k in (0, 1))
    return train(sample["text"].tolist(), toxic.tolist(), stands_for)


def scores(text: Column, model: ToxicityModel, docs: DataFrame) -> Column:
    """The probability of being toxic as a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.score(texts.tolist()), dtype="float64")

    return judge(text.cast("string"))


def predict(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: identifier, held_out, score, predicted."""
    judged = docs.select(
        F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), scores(F.col(text_col), model, docs).alias("score")
    )
    return judged.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.filter(scores(F.col(text_col), model, docs) < threshold)
