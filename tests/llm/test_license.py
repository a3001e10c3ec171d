from __future__ import annotations

import random
from collections import Counter

from biospark.llm import license
from tests.llm.conftest import prose, table

SCANNER = license.Scanner(license.TEMPLATES)


def brute(text):
    found = []
    for start, end in sorted(SCANNER._parts(text or "")):
        words = license.normalised(text[start:end])
        if not words:
            continue
        scores = {n: license.dice(license.bigrams(words), license.bigrams(license.normalised(t))) for n, t in license.TEMPLATES.items()}
        best = max(scores.values())
        if best >= license.THRESHOLD:
            found.append((start, end, min(n for n, s in scores.items() if s == best), best))
    return found


def test_pruning_loses_nothing():
    rng = random.Random(0)
    texts = list(license.TEMPLATES.values())
    for text in list(texts):
        words = text.split()
        for _ in range(12):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 4))):
                i = rng.randrange(len(changed))
                changed[i : i + 1] = rng.choice([[], ["other"], [changed[i], "more"]])
                if not changed:
                    changed = ["x"]
            lead = rng.choice(["", prose(rng.random(), 20) + "\n", "Some words. ", "One.\n\n"])
            texts.append(lead + " ".join(changed) + rng.choice(["", " tail", "\nThe end."]))
    hits = 0
    for text in texts:
        expected = brute(text)
        assert SCANNER.scan(text) == expected
        hits += len(expected)
    assert hits > len(license.TEMPLATES) * 4


def test_places_and_near_versions(spark):
    text = f"{prose(1, 30)}\nLicensed under the apache license,  version 2.0!\n{prose(2, 30)} All rights reserved."
    (a, b) = license.license_scan(table(spark, [(1, text)])).orderBy("start").collect()
    assert (a["license"], a["part"]) == ("apache-2.0-notice", "Licensed under the apache license,  version 2.0!")
    assert (b["license"], b["part"]) == ("all-rights-reserved", "All rights reserved.")
    assert text[a["start"] : a["end"]] == a["part"] and a["dice"] == 1.0


def test_clean_texts_have_no_finding():
    assert not any(SCANNER.scan(prose(i, 100)) for i in range(30))
    assert not SCANNER.scan("The rights of all people are reserved for the license of the public.")


def test_one_word_template(spark):
    scanner = license.Scanner({"one": "Unlicensed!"})
    assert scanner.scan("a\nunlicensed\nb") == [(2, 12, "one", 1.0)]


def test_odd_rows_and_empty_table(odd, nothing, spark):
    found = license.license_scan(odd)
    assert found.count() == 0 and found.schema["doc_id"].dataType.simpleString() == "bigint"
    assert license.license_scan(nothing).count() == 0
    rows = [(2**60 + 1, "All rights reserved."), (None, "All rights reserved.")]
    assert {r["doc_id"] for r in license.license_scan(table(spark, rows)).collect()} == {2**60 + 1, None}


def brute_windows(words, scanner):
    """Per template all windows, the most similar first without overlaps; then one template per place."""
    found = []
    for name, grams in scanner.grams.items():
        single = len(next(iter(grams))) == 1
        every = []
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                own = Counter((w,) for w in words[a:b]) if single and b == a + 1 else Counter(zip(words[a:b], words[a + 1 : b]))
                score = license.dice(own, grams)
                if score >= license.THRESHOLD - 1e-12:
                    every.append((a, b, name, score))
        taken = []
        for w in sorted(every, key=lambda w: (-w[3], w[0], w[1])):
            if all(w[1] <= t[0] or t[1] <= w[0] for t in taken):
                taken.append(w)
        found += taken
    kept = []
    for f in sorted(found, key=lambda f: (-f[3], f[2], f[0])):
        if not any(2 * (min(f[1], k[1]) - max(f[0], k[0])) > max(f[1] - f[0], k[1] - k[0]) for k in kept):
            kept.append(f)
    return kept


def test_windows_against_all_windows():
    rng = random.Random(1)
    names = ["all-rights-reserved", "apache-2.0-notice", "gpl-header", "isc", "mit-notice", "mit-notice-licensed"]
    scanner = license.Scanner({n: license.TEMPLATES[n] for n in names} | {"one": "Unlicensed!", "again": "to be or not to be or not"})
    hits = 0
    for _ in range(60):
        words = []
        for name in rng.choices(sorted(scanner.templates), k=rng.randint(1, 4)):
            own = license.normalised(scanner.templates[name]).split()
            for _ in range(rng.randint(0, 1 + len(own) // 8)):
                i = rng.randrange(len(own))
                own[i : i + 1] = rng.choice([[], [own[i], "other"], ["other"], [rng.choice(own)]]) or own[i : i + 1][len(own) > 1 :]
            words += own + prose(rng.random(), rng.choice([0, 1, 4])).lower().replace(".", "").split()
        expected = brute_windows(words[:90], scanner)
        assert scanner.windows(words[:90]) == expected
        hits += len(expected)
    assert hits > 90


def test_notices_that_are_no_part_of_their_own(spark):
    header = license.TEMPLATES["gpl-header"].split()
    wrapped = "\n".join("# " + " ".join(header[i : i + 9]) for i in range(0, len(header), 9))
    warranty = "# This program comes without any warranty and its makers are not liable for what it does to you\n" * 6
    mit = license.BODIES["mit"].split()
    rows = [
        (1, "The code of this project is released under the MIT License."),
        (2, "Released under the MIT License, see the file for details."),
        (3, f"# a tool\n{wrapped}\n{warranty}"),
        (4, "Copyright 2020 The Authors\n" + "\n".join(" ".join(mit[i : i + 11]) for i in range(0, len(mit), 11)) + "\nimport os"),
        (5, "İİ x, " + "and all rights reserved by law, " + prose(4, 30)),
    ]
    found = license.license_scan(table(spark, rows)).collect()
    got = {(r["doc_id"], r["license"]): r for r in found}
    assert got[1, "mit-notice"]["part"] == "released under the MIT License"
    assert got[2, "mit-notice"]["part"] == "Released under the MIT License"
    assert got[3, "gpl-header"]["part"] == wrapped[2:-1] and got[3, "gpl-header"]["dice"] == 1.0
    assert got[4, "mit"]["dice"] >= 0.98
    assert got[5, "all-rights-reserved"]["part"] == "all rights reserved"
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["part"] for r in found)


def test_full_text_inside_a_longer_file():
    scanner = license.Scanner(license.ALL_TEMPLATES)
    body = license.BODIES["gpl-3.0"].replace("General", "Genral", 3)
    text = f"{prose(1, 300)}\n{body}\n{prose(2, 300)}\nsome words and all rights reserved by us"
    found = {name: (text[start:end], score) for start, end, name, score in scanner.scan_all(text)}
    assert found["gpl-3.0"][1] > 0.99 and found["gpl-3.0"][0][:20] == body[:20]
    assert found["all-rights-reserved"] == ("all rights reserved", 1.0)
