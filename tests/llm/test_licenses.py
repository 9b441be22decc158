"""License scans against brute force, and on notices with changes."""

import itertools
import random

import numpy as np
import pytest

from sparkloom.llm import licenses as L

SCANNER = L.LicenseScanner()
BY_LABEL = {label: text for label, text in reversed(L.TEMPLATES) if len(text) > 150}


def scan(text, scanner=SCANNER):
    raw = np.frombuffer(text.encode(), np.uint8)
    return L.summary(scanner, *scanner.scan(raw, np.array([0, len(raw)]))[0])


def labels(text):
    return scan(text)[5]


def test_every_template_gives_its_label():
    for label, text in L.TEMPLATES:
        n_words, *_, base, said, score, _ = scan(f"before it {text} and after")
        assert set(said.split(",")) == {label, *filter(None, base.split(","))} and score == 1.0


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: Proprietary", ""), ("SPDX-License-Identifier: MIT-0", ""),
        ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: MIT. More", "mit"), ("Released under the terms of the agreement", ""), ("Released under the GPL license", "gpl"),
        ("Licensed under the Apache License, Version 1.1", "apache"), ("All rights reserved.", "proprietary"), ("All rights reserved. Released under the MIT License", "mit"),
        ("Copyright (c) 2001 A. All rights reserved. " + BY_LABEL["bsd"], "bsd"), ("permission to use the software for any purpose is not what this says", ""),
        (BY_LABEL["mit"].replace("the Software", "the Program", 2), "mit"), ("", ""),
    ],
)
def test_labels(text, expected):
    assert labels(text) == expected


def test_an_older_version_is_no_full_notice():
    assert scan("Licensed under the Apache License, Version 1.1")[6] == 0.5


def test_every_copy_of_a_template_is_a_span():
    notice = BY_LABEL["mit"]
    n = len(L.template_words(notice))
    for between in ("", "and then "):
        k = len(between.split())
        said = scan((f"{notice} {between}") * 3)[7]
        assert said == ",".join(f"mit:{i * (n + k)}:{i * (n + k) + n}" for i in range(3))


def test_a_run_that_stands_twice_in_a_template():
    words = "alpha beta gamma delta one two three four five six alpha beta gamma delta seven eight nine ten"
    scanner = L.LicenseScanner((("x", words),), ())
    text = "alpha beta gamma delta seven eight nine ten"
    assert scan(text, scanner)[5] == ""
    text = "one two three four five six alpha beta gamma delta seven eight nine ten"
    assert scan(text, scanner)[5:] == ("x", round(14 / 18, 6), "x:0:14")


def brute_runs(text, template):
    """Runs of the template in the text that no word before or after extends, with every place."""
    longest = {}
    for i, j in itertools.product(range(len(text)), range(len(template))):
        n = 0
        while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
            n += 1
        for m in range(L.LEAST_MATCH, n + 1):
            longest[i + m] = max(longest.get(i + m, 0), m)
    found = set()
    for end, n in longest.items():
        if longest.get(end + 1, 0) != n + 1:
            run = text[end - n : end]
            found |= {(end - n, j, n) for j in range(len(template) - n + 1) if template[j : j + n] == run}
    return found


def brute_best(parts):
    """Words of the best chain that ends at each part."""
    parts = sorted(parts)
    best = {}
    for i, (at, place, n) in enumerate(parts):
        best[parts[i]] = n
        for b_at, b_place, b_n in parts[:i]:
            gap, skip = at - b_at - b_n, place - b_place - b_n
            lap = max(0, -gap, -skip)
            if b_at < at and b_place < place and gap <= L.GAP and skip <= L.SKIP and lap < min(n, b_n):
                best[parts[i]] = max(best[parts[i]], best[b_at, b_place, b_n] + n - lap)
    return best


def test_runs_and_chains_are_brute_force():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(7)]
    for _ in range(60):
        templates = [[rng.choice(words) for _ in range(rng.randint(L.SHORT + 1, 30))] for _ in range(3)]
        scanner = L.LicenseScanner([(str(k), " ".join(t)) for k, t in enumerate(templates)], ())
        text = []
        while len(text) < 60:
            t = rng.choice(templates)
            a = rng.randrange(len(t))
            text += t[a : a + rng.randint(2, 12)] + [rng.choice([*words, "other"])] * rng.randint(0, 2)
        token = dict(zip(sorted({w for t in templates for w in t}), range(99), strict=False))
        found = {}
        begin = 0
        for known, group in itertools.groupby(text, key=lambda w: w in token):
            group = list(group)
            if known:
                scanner.walk([token[w] for w in group], begin, [], found)
            begin += len(group)
        for k, template in enumerate(templates):
            parts = brute_runs(text, template)
            assert set(found.get(k, [])) == parts
            best = brute_best(parts)
            least = 0.3 * len(template)
            spans = L.chains(list(parts), least)
            assert all(n >= least for n, _, _ in spans) and all(x[2] <= y[1] for x, y in itertools.pairwise(spans))
            assert bool(spans) == any(n >= least for n in best.values())
            assert not best or max((n for n, _, _ in spans), default=0) <= max(best.values()) and sum(n for n, _, _ in spans) >= max([n for n in best.values() if n >= least], default=0)


def test_long_texts_take_time_in_proportion():
    notice = BY_LABEL["gpl"]
    assert scan(f"{notice} " * 500)[7].count("gpl:") == 500
    assert scan("of the license or of the software " * 20_000)[5] == ""


def test_names_that_clash(spark):
    rows = spark.createDataFrame([(1, "Released under the MIT License", "a", 2), (None, None, "b", 3), (1, "Released under the MIT License", "a", 2)], "doc_id long, text string, key string, labels int")
    found = L.scan(rows)
    assert sorted((str(r["doc_id"]), r["labels"], r["n_words"]) for r in found.collect()) == [("1", "mit", 5), ("1", "mit", 5), ("None", "", 0)]
    assert L.scan(rows.limit(0)).count() == 0
    other = rows.withColumnRenamed("doc_id", "spans_").withColumnRenamed("text", "base_labels")
    assert L.scan(other, key="spans_", text="base_labels").count() == 3
