import random
from collections import Counter

import pytest
from tests.llm import brute

from docloom.llm import line_dedup as ld


def changed(r, text, edits):
    text = list(text)
    for _ in range(edits):
        k, at = r.random(), r.randrange(len(text) + 1)
        if k < 0.4 and at < len(text):
            text[at] = r.choice("abcxé")
        elif k < 0.7 and at < len(text):
            del text[at]
        else:
            text.insert(at, r.choice("abcxé"))
    return "".join(text)


def test_distance_and_keys():
    r = random.Random(11)
    for _ in range(4000):
        a = "".join(r.choice("abé") for _ in range(r.randrange(0, 16)))
        b, tau = changed(r, a, r.randrange(0, 5)), r.randrange(0, 4)
        near = brute.edit_distance(a, b) <= tau
        assert ld.within(a, b, tau) == near
        if near and min(len(a), len(b)) > tau:
            short, long = sorted((a, b), key=len)
            assert {k for k, _, _ in ld.index_keys(short, tau)} & {k for k, _, _ in ld.probe_keys(long, tau)}


def test_points():
    """Strings share a point as told if and only if they are near."""
    r = random.Random(14)
    near = lambda keys: {k >> 1 for k in keys.tolist() if not k & 1}
    far = lambda keys: {k >> 1 for k in keys.tolist() if k & 1}
    mark = chr(0xD800)
    hits = 0
    for _ in range(3000):
        a = "".join(r.choice("abé") for _ in range(r.randrange(0, 9)))
        b = changed(r, a, r.randrange(0, 4))
        if r.random() < 0.3:  # the same segment taken out of both
            a, b = a[:3] + mark + a[3:], b[:3] + mark + b[3:]
        for edits in (1, 2):
            x, y = ld.point_keys(a, 7, edits), ld.point_keys(b, 7, edits)
            met = bool(near(x) & near(y) or near(x) & far(y) or far(x) & near(y))
            parts = list(zip(a.split(mark), b.split(mark), strict=True))
            want = sum(brute.edit_distance(p, q) for p, q in parts) <= edits
            assert met == want, (a, b, edits)
            hits += want
        assert not near(x) & near(ld.point_keys(b, 8, 2))
    assert hits > 1000


def classes(rows, tau, per=5):
    lines = [(i, k, x) for i, text in rows for k, x in enumerate((text or "").split("\n")) if brute.WORD.search(x)]
    texts = sorted({x for _, _, x in lines})
    bags = {x: Counter(x) for x in texts}
    links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= tau and sum((bags[a] - bags[b]).values()) <= tau and brute.edit_distance(a, b) <= min(tau, max(len(a), len(b)) // per)]
    root = brute.union_find(texts, links)
    key = lambda i, k: (i is not None, i or 0, k)
    first = {}
    for i, k, x in lines:
        c = root[x]
        if c not in first or key(i, k) < key(*first[c]):
            first[c] = (i, k)
    return sorted([(i, k, *first[root[x]], (i, k) == first[root[x]]) for i, k, x in lines], key=repr)


@pytest.mark.parametrize(("crowd", "held"), [(64, 2_000_000), (1, 2_000_000), (4, 50)])
def test_against_all_pairs(spark, crowd, held):
    """With crowd 1 nearly every key goes down the levels; with 50 entries held, tasks give up crowded keys again and again."""
    r = random.Random(12)
    base = [brute.prose(i, r.randrange(2, 9), 20) for i in range(25)] + ["tiny", "tinx", "title", "tidle", "a b", "a c", "nineabcde", "nineabxyz", "elevenchars", "elev chars"]
    rows = [(i if i % 40 else None, "\n".join(changed(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) if r.random() < 0.8 else r.choice(["", "  ", "\t"]) for _ in range(5))) for i in range(80)]
    rows += [(200, None), (201, ""), (3, rows[3][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int").repartition(4)
    have = sorted([tuple(x) for x in ld.dedup(docs, crowd=crowd, held=held).collect()], key=repr)
    assert have == classes(rows, 2)


@pytest.mark.parametrize("tau", [1, 2])
def test_crowds(spark, tau):
    """Hundreds of lines that share most of their text meet at few keys."""
    stem = brute.prose(13, 12)
    rows = [(i, f"{stem} {i * 37:05d} tail of the line{'s' * (i % 3 == 0)}") for i in range(120)] + [(900 + i, f"{i:03d} {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    have = sorted([tuple(x) for x in ld.dedup(docs, crowd=2, tau=tau, held=2000).collect()], key=repr)
    assert have == classes(rows, tau)


def test_many_lines_of_a_template(spark):
    """20,000 lines that differ in a number of eight digits; classes held against all pairs that differ in two digits or fewer."""
    r = random.Random(15)
    numbers = [f"{r.randrange(10**8):08d}" for _ in range(20_000)]
    stem = "x".join(brute.prose(16, 12))[:60]
    docs = spark.createDataFrame([(i, f"{stem}{n}") for i, n in enumerate(numbers)], "doc_id long, text string").repartition(4)
    have = {x.doc_id: x.class_id for x in ld.dedup(docs).collect()}
    # Single deletions and replaced pairs of digits reach all that is two edits away and has eight digits.
    at = {}
    for i, n in enumerate(numbers):
        for a in range(8):
            at.setdefault(("d", n[:a] + n[a + 1 :]), []).append(i)
            for b in range(a):
                at.setdefault(n[:b] + "?" + n[b + 1 : a] + "?" + n[a + 1 :], []).append(i)
    root = brute.union_find(range(len(numbers)), [(g[0], x) for g in at.values() for x in g[1:]])
    assert have == root


def test_long_lines(spark):
    """A line of a million characters is taken whole."""
    long = brute.prose(17, 200_000)
    rows = [(0, long), (1, long[:500_000] + "!" + long[500_001:]), (2, long[:-3]), (3, "short")]
    got = {x.doc_id: x.class_id for x in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_empty(spark):
    assert ld.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    assert sorted([tuple(x) for x in ld.dedup(docs).collect()], key=repr) == classes(rows, 2)
