"""License notices found by patience alignment of a text with license templates.

A template's words are aligned with a stretch of the text: words that occur once in both
are anchors, the longest increasing subsequence of their places is kept, and the gaps
between neighbouring anchors are aligned the same way. Coverage is the share of the
template's words that are matched.

A stretch is a window of one and a half times the template's length that begins at one of the
template's words. Each that holds enough of its words (counted with repeats) is aligned. That
count is an upper bound of what an alignment can match, so no stretch that could reach the
threshold is passed over.

Licenses of a family differ in a word or two, so a match must hold the words that tell its
template from its siblings (a name, a version, a clause), and where matches of several templates
overlap the one that matches most words counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table

MIN_COVERAGE = 0.8
#: A stretch may be longer than the template by this factor.
STRETCH = 1.5

# Notices of public licenses.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES: dict[str, str] = {
    "MIT": MIT_GRANT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT grant": MIT_GRANT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": BSD_TWO,
    "BSD-3-Clause": BSD_TWO + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-1.1 notice": "Licensed under the Apache Software License, Version 1.1.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

# Licenses of the GNU family and of Creative Commons by their names and versions.
GNU = {"GPL": ("General Public License", ("1", "2", "3")), "LGPL": ("Lesser General Public License", ("2.1", "3")), "AGPL": ("Affero General Public License", ("3",))}
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS, CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("2.0", "2.5", "3.0", "4.0")
SHORT_NAMES = {"MIT": "MIT", "BSD": "BSD", "ISC": "ISC", "GPL": "GPL", "LGPL": "LGPL", "AGPL": "AGPL", "MPL": "MPL", "Apache": "Apache"}

#: Words of a template that must be matched, whatever its coverage: those that tell it from its siblings.
REQUIRED: dict[str, tuple[str, ...]] = {
    "MIT": ("merchantability",), "MIT grant": ("sublicense",), "ISC": ("fee",), "BSD-2-Clause": ("redistributions",), "BSD-3-Clause": ("neither", "endorse"), "Apache-2.0": ("apache", "2.0"), "Apache-1.1 notice": ("apache", "1.1"),
    "Apache-2.0 notice": ("apache", "2.0"), "MPL-2.0": ("mozilla", "2.0"), "MPL-1.1": ("mozilla", "1.1"), "CC0-1.0": ("cc0", "1.0"), "Unlicense": ("unencumbered",),
}


def _siblings() -> None:
    """Templates that a name and a version make, and the words that tell them apart."""
    for short, name in SHORT_NAMES.items():
        TEMPLATES[f"{short} notice"] = f"Released under the {name} License."
        REQUIRED[f"{short} notice"] = (name.lower(),)
    for short, (name, versions) in GNU.items():
        for version in versions:
            shown = f"{short}-{version}" + ".0" * ("." not in version)
            own = (name.split()[0].lower(), version)
            TEMPLATES[shown] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
            TEMPLATES[f"{shown} notice"] = f"This work is licensed under the GNU {name}, version {version}."
            REQUIRED[shown] = REQUIRED[f"{shown} notice"] = own
    for kind in CC_KINDS:
        parts = [CC_PARTS[x] for x in kind.split("-")]
        for version in CC_VERSIONS:
            port = "International" if version == "4.0" else "Unported"
            TEMPLATES[f"CC-{kind}-{version}"] = f"This work is licensed under a Creative Commons {'-'.join(parts)} {version} {port} License."
            REQUIRED[f"CC-{kind}-{version}"] = (*(x.lower() for x in parts), version)
            TEMPLATES[f"CC-{kind}-{version} notice"] = f"Licensed under CC {kind} {version}."
            REQUIRED[f"CC-{kind}-{version} notice"] = (*kind.lower().split("-"), version)


_siblings()

_WORD = re.compile(r"\w+(?:\.\w+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs`` (ordered by the first) whose seconds increase."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
        back.append(piles[at - 1] if at else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the words that a patience alignment matches, in order."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Scanner:
    """``required`` has the words of a template that a match must hold; those it doesn't name need none."""

    def __init__(self, templates: dict[str, str], min_coverage: float, required: dict[str, tuple[str, ...]] | None = None):
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        self.need = [max(1, int(np.ceil(min_coverage * len(w) - 1e-9))) for w in self.words]
        self.required = [frozenset((required or {}).get(n, ())) for n in self.names]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set().union(*self.words)))}
        self.count = np.zeros((len(self.words), len(self.vocabulary)), dtype=np.int64)
        for k, words in enumerate(self.words):
            for w in words:
                self.count[k, self.vocabulary[w]] += 1

    def _stretches(self, t: int, places: list[int], kinds: list[int]) -> Iterator[int]:
        """Word places where a window begins that holds enough of the template's words."""
        width = int(np.ceil(STRETCH * len(self.words[t])))
        have = self.count[t]
        held: Counter[int] = Counter()
        fill, end = 0, 0
        for begin, kind in enumerate(kinds):
            while end < len(places) and places[end] < places[begin] + width:
                held[kinds[end]] += 1
                fill += held[kinds[end]] <= have[kinds[end]]
                end += 1
            if fill >= self.need[t]:
                yield places[begin]
            fill -= held[kind] <= have[kind]
            held[kind] -= 1

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, matched words, first and last code point of the stretch) of each place
        where a template reaches the threshold: of overlapping places, whatever their templates,
        the one with the most matched words, then the shortest, then the first."""
        words = words_of(text)
        known = [(k, v) for k, w in enumerate(words) if (v := self.vocabulary.get(w)) is not None]
        if not known:
            return []
        bag = np.bincount([v for _, v in known], minlength=len(self.vocabulary))
        bound = np.minimum(self.count, bag).sum(axis=1)
        held = {w for w in set().union(*self.required) if bag[self.vocabulary[w]]}
        places = set()
        for t in np.flatnonzero(bound >= self.need).tolist():
            if not self.required[t] <= held:
                continue
            own = [(k, v) for k, v in known if self.count[t, v]]
            for begin in self._stretches(t, [k for k, _ in own], [v for _, v in own]):
                stretch = words[begin : begin + int(np.ceil(STRETCH * len(self.words[t])))]
                matched = patience(stretch, self.words[t])
                if len(matched) >= self.need[t] and self.required[t] <= {stretch[p] for p, _ in matched}:
                    first, last = begin + matched[0][0], begin + matched[-1][0]
                    places.add((-len(matched), last - first, first, last, t))
        taken: list[tuple[int, int, int, int]] = []  # by place, apart from each other
        for n, _, first, last, t in sorted(places):
            at = bisect_left(taken, first, key=lambda x: x[0])
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                taken.insert(at, (first, last, -n, t))
        spans = [m.span() for m in _WORD.finditer(text)] if taken else []
        return [(self.names[t], n / len(self.words[t]), n, spans[first][0], spans[last][1]) for first, last, n, t in taken]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] = TEMPLATES, required: dict[str, tuple[str, ...]] = REQUIRED, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_matched, start, end) for each place where the text covers a
    template to at least ``min_coverage``; a row with nulls for a text that covers none.

    ``start`` and ``end`` are code points of the text, end exclusive. Defined cases: a null or
    empty text covers nothing; a template that occurs repeatedly is reported at each of its
    places, of overlapping ones at the best, of equals at the shortest, then the first; ids may be null or repeat,
    each row is scanned by itself; an empty table gives an empty result; other columns aren't
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage, {k: v for k, v in required.items() if k in templates})
        types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "license", "coverage", "n_matched", "start", "end"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = scanner.scan(text.as_py() or "")
                rows += [(doc_id, *f) for f in found] or [(doc_id, None, None, None, None, None)]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, start long, end long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
