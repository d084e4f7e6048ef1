import itertools
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute

from docloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight; what is above a top is shared again among the others until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed, budget = set(names), {}, share * sum(sizes.values())
    while left:
        level = (budget - sum(fixed.values())) / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in left}
        for s in over:
            fixed[s] = most * sizes[s]
            left.remove(s)
    return fixed


def test_targets(spark):
    r = random.Random(5)
    for n in (1, 2, 3, 17):
        sizes = {f"s{i}": r.choice([0, 3, 50, 1000, 20_000]) for i in range(n)} | {None: 40, "é": 7}
        have = {x.source: x.target for x in mixing.targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()}
        want = targets(sizes)
        assert all(abs(have[s] - want[s]) < 1e-6 for s in sizes), (have, want)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 400), st.sampled_from([1, 8, 4096]))
def test_fit(counts, budget, hold):
    lengths = np.array(list(counts), np.int64)
    n = np.array(list(counts.values()), np.int64)
    take = mixing.fit(lengths, n, budget, hold)
    assert (take >= 0).all() and (take <= n).all()
    sums = {sum(a * b for a, b in zip(lengths.tolist(), c, strict=True)) for c in itertools.product(*[range(x + 1) for x in n.tolist()])}
    best = min(abs(s - budget) for s in sums)
    off = abs(int((lengths * take).sum()) - budget)
    assert off == best if hold == 4096 else off <= best + 60


ROWS = [(i % 40 if i else None, ["a", "b", None, "hot", "hot", "hot"][i % 6], None if i % 31 == 0 else "" if i % 29 == 0 else brute.prose(i, i % 23), i) for i in range(240)]


def test_mix(spark):
    docs = spark.createDataFrame([*ROWS, ROWS[5], ROWS[5]], "doc_id long, source string, text string, size int")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 242
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.times <= 2
        taken[r.source] += r.size * r.times
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))


def test_mixed(spark):
    docs = spark.createDataFrame([*ROWS, ROWS[5], ROWS[5]], "doc_id long, source string, text string, size int")
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r.doc_id, r.source, r.size] += r.times
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    have = Counter((r.doc_id, r.source, len(brute.WORD.findall(r.text or ""))) for r in out.collect())
    assert have == +times


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.doc_id, r.size, r.target, r.times) for r in mixing.mix(blank).orderBy("doc_id").collect()] == [(1, 0, 0.0, 1), (2, 0, 0.0, 1)]
