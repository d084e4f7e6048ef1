"""License scans by patience alignment.

A text's words and a template's are aligned on the words that each has just once: the longest increasing subsequence of those
anchors is kept, and the gaps between anchors are aligned in the same way; a gap without an anchor, and a text whose anchors
mislead, get a longest common subsequence. What share of the template's words the alignment covers in runs says whether the license
is there. Stretches around word pairs of the template are aligned first, so a text that has a notice several times has each
counted; if none covers enough, the whole text is aligned, so a copy may be torn apart or mixed with other words.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")

#: A run of aligned words goes on over so many foreign words, and counts from so many aligned words on (or the share asked for).
RUN_GAP, RUN_WORDS = 10, 8

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)

# Notices and texts of public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + (
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    # Of any version, and the Lesser and Affero licenses' too: a word or two don't tell them apart at the coverage asked for.
    "GPL, LGPL or AGPL header": (
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version of the License, or (at your option) any later version."
    ),
    "Apache-2.0": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly "
        "display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
        "or non-commercial, and by any means."
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software."
    ),
}


# Whole texts of public licenses, as their publishers give them.
TEMPLATES |= {f"{x.name.removesuffix('.txt')} text": x.read_text() for x in sorted(resources.files("docloom.llm").joinpath("licenses").iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first number, in which the second increases (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect.bisect_left(tops, b)
        back[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[pile], last[pile] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _reach(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of a and each start of b, bit-parallel over b."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a zero bit is a step up
    for w in a:
        if same := at.get(w):
            up = row & same
            row = ((row + up) | (row - up)) & full
    return list(itertools.accumulate((0 if row >> j & 1 else 1 for j in range(len(b))), initial=0))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    return _reach(a, b)[-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence: the longer one is halved and the shorter cut where the halves' lengths add up to most."""
    if len(a) < len(b):
        return [(i, j) for j, i in _common(b, a)]
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, i_end, j, j_end = work.pop()
        if i >= i_end or j >= j_end:
            continue
        if i_end - i == 1:
            if (q := next((q for q in range(j, j_end) if b[q] == a[i]), None)) is not None:
                out.append((i, q))
            continue
        half = (i + i_end) // 2
        left, right = _reach(a[i:half], b[j:j_end]), _reach(a[half:i_end][::-1], b[j:j_end][::-1])
        n = j_end - j
        best = max(range(n + 1), key=lambda k: left[k] + right[n - k])
        if left[best]:
            work.append((i, half, j, j + best))
        if right[n - best]:
            work.append((half, i_end, j + best, j_end))
    return sorted(out)


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of matching places in text and template, increasing in both: nine tenths of the most that there can be, or more."""
    pairs = _patience(text, template)
    if len(pairs) < len(template) and 10 * len(pairs) < 9 * common_length(text, template):
        return _common(text, template)
    return pairs


def _patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        i, i_end, j, j_end = work.pop()
        while i < i_end and j < j_end and text[i] == template[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and text[i_end - 1] == template[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        have, want = Counter(text[i:i_end]), Counter(template[j:j_end])
        at = {template[q]: q for q in range(j, j_end) if want[template[q]] == 1}
        anchors = _increasing([(p, at[text[p]]) for p in range(i, i_end) if have[text[p]] == 1 and text[p] in at])
        if not anchors:
            if have.keys() & want.keys():
                out += [(i + p, j + q) for p, q in _common(text[i:i_end], template[j:j_end])]
            continue
        for p, q in [*anchors, (i_end, j_end)]:
            work.append((i, p, j, q))
            if p < i_end:
                out.append((p, q))
                i, j = p + 1, q + 1
    return sorted(out)


def _in_runs(pairs: list[tuple[int, int]], least: int, gap: int) -> list[tuple[int, int]]:
    """The pairs in runs of `least` or more, in which text and template go on within `gap` foreign words."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for pair in pairs:
        if run and (pair[0] - run[-1][0] > gap + 1 or pair[1] - run[-1][1] > gap + 1):
            out += run if len(run) >= least else []
            run = []
        run.append(pair)
    return out + (run if len(run) >= least else [])


class Scanner:
    """Finds the templates of a dictionary in texts."""

    def __init__(self, templates: Mapping[str, str], min_coverage: float):
        self.names = list(templates)
        self.templates = [words_of(templates[x]) for x in self.names]
        self.need = [min_coverage * len(w) for w in self.templates]
        self.counts = [Counter(w) for w in self.templates]
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = {}
        self.having: dict[str, list[tuple[int, int]]] = {}  # (template, how often) by word
        for k, words in enumerate(self.templates):
            for q, pair in enumerate(itertools.pairwise(words)):
                self.pairs.setdefault(pair, []).append((k, q))
            for w, n in self.counts[k].items():
                self.having.setdefault(w, []).append((k, n))

    def __call__(self, text: str | None) -> Iterator[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, end word, occurrences) of each template that the text has; the best occurrence."""
        words = words_of(text)
        have = Counter(w for w in words if w in self.having)
        total = [0] * len(self.templates)
        for w, m in have.items():
            for k, n in self.having[w]:
                total[k] += min(m, n)
        # A template can't be covered by words that the text doesn't have.
        likely = [k for k, n in enumerate(total) if n and n >= self.need[k]]
        if not likely:
            return
        starts: dict[int, list[int]] = {k: [] for k in likely}
        for p, pair in enumerate(itertools.pairwise(words)):
            for k, q in self.pairs.get(pair, ()):
                if k in starts:
                    starts[k].append(p - q)
        for k in likely:
            if found := self._stretches(k, words, starts[k]) or self._whole(k, words):
                yield self.names[k], *max(found, key=lambda x: (x[0], -x[1])), len(found)

    def _stretches(self, k: int, words: list[str], starts: list[int]) -> list[tuple[float, int, int]]:
        """Copies whose words stand within a stretch around word pairs of the template."""
        template, spans, found = self.templates[k], [], []
        slack = len(template) // 4 + 2
        for o in sorted(starts):
            # Stretches grow while offsets drift by little; a second copy starts one of its own.
            if spans and o - spans[-1][1] <= slack:
                spans[-1][1] = o
            else:
                spans.append([o, o])
        for lo, hi in spans:
            lo, hi = max(0, lo - slack), min(len(words), hi + len(template) + slack)
            part = words[lo:hi]
            have = Counter(part)
            if sum(min(n, have[w]) for w, n in self.counts[k].items()) < self.need[k]:
                continue
            pairs = align(part, template)
            if len(pairs) >= self.need[k]:
                found.append((len(pairs) / len(template), lo + pairs[0][0], lo + pairs[-1][0] + 1))
        return found

    def _whole(self, k: int, words: list[str]) -> list[tuple[float, int, int]]:
        """The whole text at once, without the words that the template doesn't have."""
        places = [p for p, w in enumerate(words) if w in self.counts[k]]
        pairs = [(places[p], q) for p, q in align([words[p] for p in places], self.templates[k])]
        pairs = _in_runs(pairs, min(RUN_WORDS, math.ceil(self.need[k])), min(RUN_GAP, len(self.templates[k]) // 4 + 2))
        return [(len(pairs) / len(self.templates[k]), pairs[0][0], pairs[-1][0] + 1)] if pairs and len(pairs) >= self.need[k] else []


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = 0.8) -> DataFrame:
    """(id_col, license, coverage, first_word, end_word, occurrences): a row for each document and template that covers.

    Words are compared without case and punctuation; first_word and end_word are places among the text's words. A copy whose
    words don't stand together is found if its words stand in runs of RUN_WORDS or more (a shorter template's: of min_coverage of it), with
    up to RUN_GAP foreign words between two (a quarter of its own and two, if fewer). Empty templates are never found. Null and empty texts have no license; rows that repeat give rows each; other columns are ignored.
    templates travel with the task: they are the caller's own dictionary, not data of the table.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        for batch in batches:
            ids, rows = [], []
            for doc_id, x in zip(batch.column(0), batch.column(1), strict=True):
                for row in scanner(x.as_py()):
                    ids.append(doc_id.as_py())
                    rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["id", "license", "coverage", "first_word", "end_word", "occurrences"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, license string, coverage double, first_word long, end_word long, occurrences long")
    return out.withColumnRenamed("id", id_col)
