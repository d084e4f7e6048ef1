import random
import tracemalloc
from collections import Counter

import pytest
from tests.llm import brute

from docloom.llm import license_scan as ls


def test_increasing_is_longest():
    r = random.Random(9)
    for _ in range(100):
        b = r.sample(range(12), r.randrange(0, 9))
        best = max((bin(m).count("1") for m in range(1 << len(b)) if (s := [x for i, x in enumerate(b) if m >> i & 1]) == sorted(s)), default=0)
        found = ls._increasing(list(enumerate(b)))
        assert len(found) == best and [x for _, x in found] == sorted(x for _, x in found)


def test_align_pairs_equal_words_in_order():
    r = random.Random(10)
    for _ in range(200):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randrange(0, 14))] for _ in range(2))
        pairs = ls.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(ls.align(a, a)) == len(a)


def test_scan(spark):
    t = ls.TEMPLATES
    rows = [
        (1, f"{brute.prose(1, 100)}\n{t['MIT notice']}\n{brute.prose(2, 50)}", {"MIT notice"}),
        (2, t["MIT"].lower().replace(",", " ;"), {"MIT"}),
        (3, t["MIT"].replace("copies of the Software", "the Work").replace("sublicense, ", ""), {"MIT"}),
        (4, " ".join([t["Apache-2.0 notice"], brute.prose(3, 30)] * 3), {"Apache-2.0 notice"}),
        (5, f"this license is the work {brute.prose(4, 60)} public general version 3 license", set()),
        (6, t["GPL-3.0 notice"] + " the the " + t["CC-BY-NC-4.0 notice"], {"GPL-3.0 notice", "CC-BY-NC-4.0 notice"}),
        (7, None, set()),
        (8, "", set()),
        (9, " ".join(t["MIT"].split()[:30]), set()),
    ]
    df = spark.createDataFrame([(i, x, 1) for i, x, _ in rows] + [(None, t["ISC"], 1), (1, rows[0][1], 1)], "doc_id long, text string, license int")
    out = ls.scan(df).collect()
    found = {}
    for r in out:
        found.setdefault(r.doc_id, set()).add(r.license)
        assert 0.8 <= r.coverage <= 1 and r.first_word < r.end_word
    assert found == {i: w for i, _, w in rows if w} | {None: {"ISC"}}
    assert sum(r.doc_id == 1 for r in out) == 2
    assert [r.occurrences for r in out if r.doc_id == 4] == [3]
    assert [(r.first_word, r.end_word) for r in out if r.doc_id == 1][0] == (100, 105)
    assert ls.scan(df.limit(0)).count() == 0 and ls.scan(df, {}).count() == 0


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(d.doc_id, name) for d in docs.collect() for name, text in ls.TEMPLATES.items() if text in d.text}
    assert {(r.doc_id, r.license) for r in ls.scan(docs).collect()} == want


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of Some University nor the names of its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This file is part of X. X is free software: you can redistribute it and/or modify
it under the terms of the GNU %sGeneral Public License as published by
the Free Software Foundation, either version %d of the License, or
(at your option) any later version."""
HEADER = "GPL, LGPL or AGPL header"


@pytest.mark.parametrize(
    ("text", "names"),
    [(BSD, {"BSD-2-Clause"}), (BSD + THIRD, {"BSD-2-Clause", "BSD-3-Clause"}), (GPL % ("", 3), {HEADER}), (GPL % ("", 2), {HEADER}), (GPL % ("Lesser ", 3), {HEADER}), (GPL % ("Affero ", 3), {HEADER})],
)
def test_bodies_and_headers(text, names):
    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    assert {r[0] for r in scanner(f"some words before {text} and some after")} == names


def test_each_template_finds_itself():
    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    for name, text in ls.TEMPLATES.items():
        found = {r[0]: r[1] for r in scanner(text)}
        assert found[name] == 1
        for other in found:  # those that it quotes, or nearly
            words = ls.words_of(ls.TEMPLATES[other])
            assert plain_common(ls.words_of(text), words) >= 0.8 * len(words)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_align_is_nearly_longest():
    r = random.Random(13)
    for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(300):
            a, b = ([r.choice(letters) for _ in range(r.randrange(0, 40))] for _ in range(2))
            longest = plain_common(a, b)
            assert ls.common_length(a, b) == longest
            exact = ls._common(a, b)
            assert len(exact) == longest and all(a[i] == b[j] for i, j in exact)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(exact, exact[1:], strict=False))
            assert longest >= len(ls.align(a, b)) >= 0.9 * longest


@pytest.mark.parametrize("name", ["MIT", "MIT text", "GPL-3 text", "BSD notice"])
def test_torn_and_mixed_copies(name):
    """Words put between, and a copy in two halves, are found wherever the alignment covers the template."""
    scanner = ls.Scanner({name: ls.TEMPLATES[name]}, 0.8)
    words = ls.TEMPLATES[name].split()
    r = random.Random(14)
    mixed = " ".join(x for w in words for x in (w, f"foreign{r.randrange(50)}"))
    assert [x[0] for x in scanner(f"{brute.prose(1, 300)} {mixed} {brute.prose(2, 300)}")] == [name]
    half = len(words) // 2
    torn = " ".join([*words[:half], brute.prose(3, 400), *words[half:]])
    assert [x[0] for x in scanner(torn)] == [name]
    # All of its words, but far from one another or in another order, are no copy.
    assert not list(scanner(" ".join(f"{w} {brute.prose(i, 30)}" for i, w in enumerate(words[:200]))))
    assert not list(scanner(" ".join(r.sample(words, len(words)))))


def test_long_text():
    """A million words with a license in them, and a million of a license's own commonest words."""
    scanner = ls.Scanner(ls.TEMPLATES, 0.8)
    text = brute.prose(5, 500_000)
    assert {x[0] for x in scanner(f"{text} {ls.TEMPLATES['Apache-2.0 text']} {text}")} >= {"Apache-2.0 text"}
    r = random.Random(15)
    common = [w for w, _ in Counter(ls.words_of(ls.TEMPLATES["GPL-3 text"])).most_common(300)]
    tracemalloc.start()
    list(scanner(" ".join(r.choice(common) for _ in range(300_000))))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
