"""License scans with a generalised suffix automaton over the words of license templates.

The automaton holds every run of words of every template. A text is streamed through it: after each word the automaton's
state and its suffix links give, for each template, the longest run ending there that stands in it (the matching
statistics). A word outside the templates' vocabulary leads back to the start, so only runs of known words are walked, and
those are found with array operations on word hashes.

Runs that no further word extends are then chained, at every place where they stand in a template: runs whose places advance
both in the text and in the template, no more than ``GAP`` words apart in the text and ``SKIP`` in the template, cover a
span. The spans of a template that cover ``COVERED`` of it or more and lie apart are chosen so that they hold the most
words, however many there are. A template of up to ``SHORT`` words has to stand there word for word, and must not go on
with a hyphen or a point, as ``MIT-0`` does. Of spans of different labels that overlap by more than half of the shorter, the
one with more words stays. The labels in ``WEAK`` are given only where nothing else is. The three base phrases are
sequences of the automaton too, and their places are read off the same walk, from the phrases on a state's suffix path.

The score is the largest share of a template that a span covers, or 0.5 where only a base phrase stands.

Cases: a null or empty text has no words, no labels and score 0; texts are scanned whole, however long, in time in proportion;
repeated rows give repeated results; a null key is kept; an empty table gives an empty result; only the columns named are
read, so other columns may have any name.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.common import arrow_map, flat, runs, table

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices and declarations, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "All rights reserved"),
)

#: Names of licenses in a sentence, and identifiers of the SPDX list, with their labels.
NAMES = (
    ("MIT License", "mit"), ("Apache License, Version 2.0", "apache"), ("Apache 2.0 License", "apache"), ("GPL", "gpl"), ("GNU GPL", "gpl"),
    ("GNU General Public License", "gpl"), ("LGPL", "lgpl"), ("GNU Lesser General Public License", "lgpl"), ("BSD License", "bsd"),
    ("BSD 2-Clause License", "bsd"), ("BSD 3-Clause License", "bsd"), ("ISC License", "isc"), ("Mozilla Public License", "mpl"), ("Unlicense", "unlicense"),
)
IDENTIFIERS = (
    ("MIT", "mit"), ("Apache-2.0", "apache"), ("GPL-2.0", "gpl"), ("GPL-2.0-only", "gpl"), ("GPL-2.0-or-later", "gpl"), ("GPL-3.0", "gpl"), ("GPL-3.0-only", "gpl"),
    ("GPL-3.0-or-later", "gpl"), ("LGPL-2.1-only", "lgpl"), ("LGPL-2.1-or-later", "lgpl"), ("LGPL-3.0-only", "lgpl"), ("LGPL-3.0-or-later", "lgpl"), ("BSD-2-Clause", "bsd"),
    ("BSD-3-Clause", "bsd"), ("ISC", "isc"), ("MPL-2.0", "mpl"), ("Unlicense", "unlicense"), ("CC0-1.0", "cc0"), ("CC-BY-4.0", "cc-by"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC-BY-NC-4.0", "cc-by-nc"),
)
TEMPLATES += tuple((label, f"{verb} under the {name}") for name, label in NAMES for verb in ("Licensed", "Released", "Distributed"))
TEMPLATES += tuple((label, f"SPDX-License-Identifier: {name}") for name, label in IDENTIFIERS)

#: Labels given only where no other is.
WEAK = frozenset(["proprietary"])
#: Words of the longest template that must stand whole.
SHORT = 12
#: Words of a run that a chain takes up; words between two runs in the text, and in the template.
LEAST_MATCH = 3
GAP, SKIP = 8, 32
COVERED = 0.6


def template_words(text: str) -> list[bytes]:
    lowered = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, stops, _ = W.find(lowered, np.array([0, len(lowered)]), W.ALPHANUMERIC)
    data = lowered.tobytes()
    return [data[a:b] for a, b in zip(starts, stops, strict=True)]


class SuffixAutomaton:
    """A generalised suffix automaton of token sequences; ``places[s]`` has for each sequence all ends of the state's run."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.places: list[dict[int, set[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.places[last].setdefault(k, set()).add(i + 1)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            for k, ends in self.places[s].items():
                self.places[self.link[s]].setdefault(k, set()).update(ends)

    def _new(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.places.append({})
        return len(self.size) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The state of the run of ``p`` and ``token``, where ``q`` also stands for longer ones."""
        copy = self._new(self.size[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, token)
        new, p = self._new(self.size[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][token]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, token)
        return new

    def state(self, sequence: list[int]) -> int:
        s = 0
        for token in sequence:
            s = self.next[s][token]
        return s


def chains(parts: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """``words, from, to`` of the chains of at least ``least`` words that lie apart in the text and hold the most.

    parts: runs as text place, template place and words, of one template.
    """
    parts = sorted(parts)
    longest = max((n for _, _, n in parts), default=0)
    total, begin = [0] * len(parts), [0] * len(parts)
    for i, (at, place, n) in enumerate(parts):
        total[i], begin[i] = n, at
        j = i - 1
        while j >= 0 and parts[j][0] + longest >= at - GAP:
            before_at, before_place, before_n = parts[j]
            gap, skip = at - before_at - before_n, place - before_place - before_n
            # runs may overlap by a word or two where the text departs from the template
            lap = max(0, -gap, -skip)
            if before_at < at and before_place < place and gap <= GAP and skip <= SKIP and lap < min(n, before_n) and total[j] + n - lap > total[i]:
                total[i], begin[i] = total[j] + n - lap, begin[j]
            j -= 1
    spans = sorted((at + n, begin[i], total[i]) for i, (at, _, n) in enumerate(parts) if total[i] >= least)
    stops = [stop for stop, _, _ in spans]
    most, taken = [0], []
    for i, (_, start, words) in enumerate(spans):
        before = bisect.bisect_right(stops, start, 0, i)
        taken.append(before if most[before] + words > most[i] else -1)
        most.append(max(most[i], most[before] + words))
    found, i = [], len(spans)
    while i:
        if taken[i - 1] >= 0:
            found.append((spans[i - 1][2], spans[i - 1][1], spans[i - 1][0]))
            i = taken[i - 1]
        else:
            i -= 1
    return found[::-1]


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        sequences = [template_words(text) for _, text in templates]
        phrase_words = [template_words(text) for text, _ in phrases]
        vocabulary = sorted({w for s in [*sequences, *phrase_words] for w in s})
        token = {w: i for i, w in enumerate(vocabulary)}
        data = np.frombuffer(b" ".join(vocabulary), np.uint8)
        stops = np.cumsum([len(w) + 1 for w in vocabulary]) - 1
        starts = np.concatenate(([0], stops[:-1] + 1))
        hashed = W.hashes(data, starts, stops)
        order = np.argsort(hashed)
        self.known, self.token = hashed[order], order.astype(np.int32)
        self.sizes = [len(s) for s in sequences]
        self.automaton = a = SuffixAutomaton([[token[w] for w in s] for s in [*sequences, *phrase_words]])
        self.n_templates = len(sequences)
        whole = {k: s for k, s in enumerate([*sequences, *phrase_words]) if k >= self.n_templates or len(s) <= SHORT}
        self.least_run = min([LEAST_MATCH, *map(len, whole.values())])
        #: By state: the sequences that must stand whole and end it, and of each other template the longest run that does.
        own: dict[int, list[tuple[int, int]]] = {}
        for k, s in whole.items():
            own.setdefault(a.state([token[w] for w in s]), []).append((k, len(s)))
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(a.size)
        self.longest: list[dict[int, int]] = [{}] * len(a.size)
        for s in sorted(range(1, len(a.size)), key=a.size.__getitem__):
            self.ending[s] = (*own.get(s, ()), *self.ending[a.link[s]])
            if a.size[s] >= LEAST_MATCH:
                self.longest[s] = self.longest[a.link[s]] | {k: s for k in a.places[s] if k not in whole}

    def tokens(self, hashed: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return np.where(self.known[at] == hashed, self.token[at], -1)

    def walk(self, tokens: list[int], begin: int, places: list, matches: dict) -> None:
        """Stream a run of known words that starts at word ``begin``; add whole places, and runs by template."""
        a = self.automaton
        s = length = 0
        held: dict[int, tuple[int, int]] = {}
        for i, token in enumerate([*tokens, -1]):
            while s > 0 and token not in a.next[s]:
                s = a.link[s]
                length = a.size[s]
            if token in a.next[s]:
                s, length = a.next[s][token], length + 1
            now = {k: (p, min(length, a.size[p])) for k, p in self.longest[s].items()} if length >= LEAST_MATCH else {}
            for k, (p, n) in held.items():
                if k not in now or now[k][1] != n + 1:
                    matches.setdefault(k, []).extend((begin + i - n, end - n, n) for end in a.places[p][k])
            held = {k: x for k, x in now.items() if x[1] >= LEAST_MATCH}
            for k, n in self.ending[s]:
                if length >= n:
                    places.append((begin + i + 1 - n, k))

    def scan(self, raw: np.ndarray, at: np.ndarray) -> list[tuple]:
        """For each text: words, base places ``word, phrase``, and covered spans ``words, share, label, from, to``."""
        lowered = W.LOWER[raw]
        starts, stops, first = W.find(lowered, at, W.ALPHANUMERIC)
        tokens = self.tokens(W.hashes(lowered, starts, stops))
        found: list[tuple] = [(int(b - a), [], []) for a, b in zip(first[:-1], first[1:], strict=True)]
        lows, highs = runs(tokens >= 0, first, self.least_run)
        texts = np.searchsorted(first, lows, "right") - 1
        edges = np.searchsorted(texts, np.arange(len(at)))
        for i in np.unique(texts).tolist():
            places: list[tuple[int, int]] = []
            matches: dict[int, list[tuple[int, int, int]]] = {}
            base = int(first[i])
            for low, high in zip(lows[edges[i] : edges[i + 1]].tolist(), highs[edges[i] : edges[i + 1]].tolist(), strict=True):
                self.walk(tokens[low:high].tolist(), low - base, places, matches)
            spans = [(n, n / self.sizes[k], self.labels[k], a, b) for k, parts in matches.items() for n, a, b in chains(parts, COVERED * self.sizes[k])]
            for word, k in places:
                if k >= self.n_templates:
                    found[i][1].append((word, k - self.n_templates))
                elif not goes_on(raw, int(stops[base + word + self.sizes[k] - 1]), int(at[i + 1])):
                    spans.append((self.sizes[k], 1.0, self.labels[k], word, word + self.sizes[k]))
            found[i][2].extend(apart(spans))
        return found


def goes_on(raw: np.ndarray, stop: int, end: int) -> bool:
    """The word that ends at ``stop`` is joined to another by a hyphen or a point."""
    return stop + 1 < end and raw[stop] in b"-." and bool(W.ALPHANUMERIC[W.LOWER[raw[stop + 1]]])


def apart(spans: list[tuple]) -> list[tuple]:
    """Those of ``words, share, label, from, to`` that no larger one of another label overlaps by over half, by place."""
    kept: list[tuple] = []
    by_label: dict[str, tuple[list[int], list[int]]] = {}
    for span in sorted(set(spans), key=lambda x: (-x[0], -x[1], x[3], x[2])):
        n, _, label, low, high = span
        lost = False
        for other, (lows, highs) in by_label.items():
            # the spans kept of one label lie apart
            i = bisect.bisect_right(highs, low)
            while i < len(lows) and lows[i] < high and not lost:
                lost = (label != other and 2 * (min(high, highs[i]) - max(low, lows[i])) > high - low) or (label == other)
                i += 1
        if not lost:
            kept.append(span)
            lows, highs = by_label.setdefault(label, ([], []))
            i = bisect.bisect_left(lows, low)
            lows.insert(i, low)
            highs.insert(i, high)
    strong = [x for x in kept if x[2] not in WEAK]
    return sorted(strong or kept, key=lambda x: (x[3], x[2]))


def summary(scanner: LicenseScanner, n_words: int, places: list, spans: list) -> tuple:
    base = {scanner.phrase_labels[k] for _, k in places}
    if base:
        spans = [x for x in spans if x[2] not in WEAK]
    own = {label for _, _, label, _, _ in spans}
    score = max([share for _, share, _, _, _ in spans] + [0.5 * bool(places)])
    at = [p for p, _ in places]
    said = ",".join(f"{label}:{a}:{b}" for _, _, label, a, b in spans)
    return n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(own | base)), round(min(1.0, score), 6), said


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its words, base places, labels, score and covered spans as ``label:from:to`` in words."""

    def make():
        scanner = LicenseScanner(templates, phrases)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, at = flat(batch.column(0))
            rows = [summary(scanner, *x) for x in scanner.scan(raw, at)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(1), *columns], ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

        return step

    return arrow_map(docs.select(F.col(text).alias("text"), F.col(key).alias("key")), make, f"key {dict(docs.dtypes)[key]}, {SCHEMA}").withColumnRenamed("key", key)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
