"""Licence scans: a text compared with licence templates by the Dice coefficient of their word bigrams.

Text and template are normalised (lower case, runs of other characters than letters and digits are one space) and
become multisets of word bigrams A and B; their similarity is 2 |A and B| / (|A| + |B|). Two kinds of places are compared:

- Parts: sentences, lines, paragraphs (lines between empty lines) and the whole text; equal parts are one. Every part that
  reaches the threshold is reported with its most similar template.
- Windows: all runs of consecutive words, wherever they begin and end. Of each template's windows that reach the threshold
  the most similar is taken (then the first, then the shortest), then the most similar that does not overlap one taken
  before, and so on. Of windows of two templates that share more than half of the longer one's words the more similar
  stays, then the first template by name. A window that shares more than half of the longer one's words with a reported
  part is that part.

A part or window of n bigrams can reach the threshold t only with templates of n t / (2 - t) to n (2 - t) / t bigrams;
others are not compared. One that reaches t with a template of m bigrams shares at least m t / (2 - t) of them, hence
k at least of any m - m t / (2 - t) + k: only words around such bigrams are searched, and texts with fewer are skipped.
The most similar windows begin and end with a bigram of the template, as any other end could be cut off. The bounds
are exact, no match is lost.

Defined cases: a null or empty text has no finding; a part of one word has no bigram and is compared by that word alone, as is a
template of one word; of equally similar templates the first by name is reported; rows that repeat are scanned each; an
empty table gives an empty result. Input columns beside identifier and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush
from math import ceil, floor

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from biospark.llm.license_texts import BODIES

THRESHOLD = 0.8

# Notices and short licence texts by name.
TEMPLATES: dict[str, str] = {
    "agpl-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
        " specific language governing permissions and limitations under the License."
    ),
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "lgpl-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Notices, headers and full texts.
ALL_TEMPLATES = TEMPLATES | BODIES

OTHER = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+")
# A sentence ends at a mark that white space follows, so that "2.0" stays whole.
PART_ENDS = (re.compile(r"(?<=[.!?])\s+|\n"), re.compile(r"\n"), re.compile(r"\n\s*\n"))


def normalised(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def placed_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of the normalised text, and where each starts and ends in ``text``."""
    lowered = text.lower()
    found = list(WORD.finditer(lowered))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    if len(lowered) != len(text):  # some letters become two
        at = [i for i, c in enumerate(text) for _ in c.lower()]
        starts, ends = [at[i] for i in starts], [at[i - 1] + 1 for i in ends]
    return [m.group() for m in found], starts, ends


def same_place(a: tuple, b: tuple) -> bool:
    """Whether two (start, end, ...) share more than half of the longer one."""
    return 2 * (min(a[1], b[1]) - max(a[0], b[0])) > max(a[1] - a[0], b[1] - b[0])


def bigrams(text: str) -> Counter:
    """The word bigrams of a normalised text; of a single word the word."""
    words = text.split()
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter([(w,) for w in words])


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


@dataclass
class Scanner:
    templates: Mapping[str, str]
    threshold: float = THRESHOLD
    grams: dict[str, Counter] = field(init=False)

    def __post_init__(self) -> None:
        self.grams = {name: bigrams(normalised(text)) for name, text in sorted(self.templates.items())}
        self.by_size: dict[int, list[str]] = {}
        everywhere = Counter(g for grams in self.grams.values() for g in grams)
        self.automaton = ahocorasick.Automaton()
        self.anchors: dict[tuple, list[str]] = {}
        self.required: dict[str, int] = {}
        for name, grams in self.grams.items():
            self.by_size.setdefault(grams.total(), []).append(name)
            # Enough bigrams, counted with repeats, that a match must hold so many; the longest and rarest tell most.
            least = ceil(grams.total() * self.threshold / (2 - self.threshold) - 1e-9)
            self.required[name] = min(1 + grams.total() // 8, max(least, 1))
            spare = grams.total() - least + self.required[name] - 1
            for gram in sorted(grams, key=lambda g: (everywhere[g], -len(" ".join(g)), g)):
                self.anchors.setdefault(gram, []).append(name)
                spare -= grams[gram]
                if spare < 0:
                    break
        for gram, names in self.anchors.items():
            self.automaton.add_word(f" {' '.join(gram)} ", names)
        self.automaton.make_automaton()

    def may_match(self, words: str) -> bool:
        """Whether a normalised text holds so many of a template's rare bigrams as each of its matches does."""
        counts: dict[str, int] = {}
        for _, names in self.automaton.iter(f" {words} "):
            for name in names:
                counts[name] = counts.get(name, 0) + 1
                if counts[name] >= self.required[name]:
                    return True
        return False

    def candidates(self, size: int) -> Iterator[str]:
        """Templates whose size allows a match with a part of ``size`` bigrams."""
        low = ceil(size * self.threshold / (2 - self.threshold) - 1e-9)
        high = floor(size * (2 - self.threshold) / self.threshold + 1e-9)
        for m in range(low, min(high, max(self.by_size, default=0)) + 1):
            yield from self.by_size.get(m, ())

    def _parts(self, text: str) -> set[tuple[int, int]]:
        spans = {(0, len(text))}
        for ends in PART_ENDS:
            start = 0
            for cut in ends.finditer(text):
                spans.add((start, cut.start()))
                start = cut.end()
            spans.add((start, len(text)))
        trimmed = set()
        for start, end in spans:
            part = text[start:end]
            body = part.strip()
            if body:
                at = start + part.index(body)
                trimmed.add((at, at + len(body)))
        return trimmed

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, template, similarity) of the parts that reach the threshold, in the order of their places."""
        if not text or not self.may_match(normalised(text)):
            return []
        found = []
        largest = max(self.by_size) * (2 - self.threshold) / self.threshold
        for start, end in sorted(self._parts(text)):
            words = normalised(text[start:end])
            if not words or words.count(" ") > largest or not self.may_match(words):
                continue
            own = bigrams(words)
            loss, name = min(((-dice(own, self.grams[name]), name) for name in self.candidates(own.total())), default=(0.0, ""))
            if -loss >= self.threshold - 1e-12:
                found.append((start, end, name, -loss))
        return found

    def _template_windows(self, name: str, grams: list[tuple], anchors: list[int]) -> Iterator[tuple[int, int, float]]:
        """(start, end, similarity) in words of one template's windows, the most similar of those that overlap."""
        template = self.grams[name]
        size = template.total()
        least = ceil(size * self.threshold / (2 - self.threshold) - 1e-9)
        most = floor(size * (2 - self.threshold) / self.threshold + 1e-9)
        width = len(next(iter(template)))
        i = 0
        while i < len(anchors):
            low, high = max(0, anchors[i] - most + 1), anchors[i] + most
            while i < len(anchors) and anchors[i] - most < high:
                high, i = anchors[i] + most, i + 1
            places = [p for p in range(low, min(high, len(grams))) if grams[p] in template]
            if len(places) < least:
                continue
            # Where the bigram stood as many times ago as the template has it: windows that begin later count it.
            seen: dict[tuple, list[int]] = {}
            spent = np.empty(len(places), np.int64)
            for k, p in enumerate(places):
                own = seen.setdefault(grams[p], [])
                spent[k] = own[-template[grams[p]]] if len(own) >= template[grams[p]] else -1
                own.append(k)
            at = np.array(places, np.int64)
            reach = np.searchsorted(at, at + most)

            def best(k: int, stop: int) -> tuple[float, int, int, int] | None:
                """The most similar window from place ``k`` to one before ``stop``."""
                shared = np.cumsum(spent[k:stop] < k)
                scores = 2 * shared / (size + at[k:stop] - at[k] + 1)
                e = int(scores.argmax()) if stop > k else 0
                return (-float(scores[e]), k, k + e, stop) if stop > k and scores[e] >= self.threshold - 1e-12 else None

            heap = [b for k in np.flatnonzero(reach - np.arange(len(at)) >= least) if (b := best(int(k), int(reach[k])))]
            heapify(heap)
            taken: list[tuple[int, int]] = []
            while heap:
                loss, k, e, stop = heappop(heap)
                start, end = int(at[k]), int(at[e]) + width
                n = bisect_left(taken, (start + 1,))
                if n and taken[n - 1][1] > start:
                    continue
                if n < len(taken) and taken[n][0] < end:
                    # Up to the window taken, no further.
                    if again := best(k, min(stop, int(np.searchsorted(at, taken[n][0] - width + 1)))):
                        heappush(heap, again)
                    continue
                insort(taken, (start, end))
                yield start, end, -loss

    def windows(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(start, end, template, similarity) in words of the windows that are reported, the most similar first."""
        pairs = list(zip(words, words[1:]))
        singles = [(w,) for w in words]
        hits: dict[str, list[int]] = {}
        for grams in (pairs, singles):
            for i, gram in enumerate(grams):
                for name in self.anchors.get(gram, ()):
                    hits.setdefault(name, []).append(i)
        found = []
        for name, at in hits.items():
            if len(at) < self.required[name]:
                continue
            grams = pairs if len(next(iter(self.grams[name]))) > 1 else singles
            found += [(start, end, name, score) for start, end, score in self._template_windows(name, grams, at)]
        return apart(sorted(found, key=lambda f: (-f[3], f[2], f[0])), [])

    def scan_all(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, template, similarity) of parts and windows, in the order of their places."""
        if not text or not self.may_match(normalised(text)):
            return []
        words, starts, ends = placed_words(text)
        parts = self.scan(text)
        inside = [(bisect_left(starts, start), bisect_left(starts, end)) for start, end, *_ in parts]
        found = apart(self.windows(words), inside)
        return sorted(parts + [(starts[a], ends[b - 1], name, score) for a, b, name, score in found])


def apart(found: list[tuple], taken: list[tuple]) -> list[tuple]:
    """Those of ``found`` that are the same place as none of ``taken`` and as none kept before."""
    kept: list[tuple] = []
    by_start = sorted(t[:2] for t in taken)
    longest = max((b - a for a, b in by_start), default=0)
    for f in found:
        n = bisect_left(by_start, (f[1],))
        clash = False
        while n and not clash and by_start[n - 1][0] > f[0] - longest:
            n -= 1
            clash = same_place(by_start[n], f)
        if not clash:
            kept.append(f)
            insort(by_start, f[:2])
            longest = max(longest, f[1] - f[0])
    return kept


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...], threshold: float) -> Scanner:
    return Scanner(dict(templates), threshold)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = ALL_TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per finding: identifier, start and end (characters of the text), license, dice, part (the text there)."""
    templates = tuple(sorted(templates.items()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(templates, threshold)
        for batch in batches:
            rows = [
                (key, start, end, name, score, text[start:end])
                for key, text in zip(batch["id"], batch["text"])
                for start, end, name, score in scanner.scan_all(text)
            ]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "license", "dice", "part"])

    id_type = docs.schema[id_col].dataType
    # The identifier passes through as text: pandas has no whole numbers with gaps.
    rows = docs.selectExpr(f"cast(`{id_col}` as string) as id", f"cast(`{text_col}` as string) as text")
    found = rows.mapInPandas(scan, "id string, start long, end long, license string, dice double, part string")
    return found.withColumn("id", found["id"].cast(id_type)).withColumnRenamed("id", id_col)
