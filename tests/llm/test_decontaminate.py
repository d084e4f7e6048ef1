import random
import tracemalloc

import numpy as np
from tests.llm import brute

from docloom.llm import decontaminate as dc


def edited(text, share, seed):
    r, out = random.Random(seed), []
    for w in text.split():
        k = r.random()
        if k < share / 3:
            continue
        if k < share * 2 / 3:
            out.append(f"new{r.randrange(999)}")
            continue
        out.append(w)
        if k > 1 - share / 3:
            out.append("put-in")
    return " ".join(out)


def test_alignment_against_the_full_matrix():
    r = random.Random(8)
    for _ in range(200):
        a = [r.randrange(4) for _ in range(r.randrange(1, 9))]
        b = [r.randrange(4) for _ in range(r.randrange(1, 12))]
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
        assert dc.align(np.array(a), np.array(b))[0] == max(map(max, h))


ITEMS = [(i, brute.prose(100 + i, 20 + i)) for i in range(12)]
CLEAN = [(i, brute.prose(500 + i, 200)) for i in range(60)]


def test_copies_are_found(spark):
    docs = list(CLEAN)
    want = set()
    for k, (item, text) in enumerate(ITEMS):
        for n, copy in enumerate((text, text.upper().replace(" ", ", "), edited(text, 0.15, k), "\n".join(text.split()))):
            docs.append((1000 + 10 * k + n, f"{brute.prose(900 + k, 150)} {copy} {brute.prose(950 + k, 90)}"))
            vocabulary = {w: i for i, w in enumerate(dc.words_of(text))}
            score, _ = dc.align(np.arange(len(vocabulary)), np.array([vocabulary.get(w, -1) for w in dc.words_of(copy)]))
            if score >= 0.6 * dc.MATCH * len(vocabulary):
                want.add((1000 + 10 * k + n, item))
    assert len(want) > 4 * len(ITEMS) - 5
    docs += [(5000 + i, f"{brute.prose(20_000 + i, 20)} {ITEMS[3][1]}") for i in range(300)]  # one item has leaked far and wide
    want |= {(5000 + i, 3) for i in range(300)}
    docs += [(6000 + i, " ".join(ITEMS[4][1].split()[:3]) + " " + brute.prose(7000 + i, 50)) for i in range(30)]
    docs += [(6999, None), (8, ""), (None, "no id"), (6998, "two words"), (1234, "it has two other words")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    bench = spark.createDataFrame([*ITEMS, (90, None), (91, ""), (92, "two words")], "item_id long, text string")
    two = {(6998, 92), (1234, 92)}
    for chars in (16_000_000, 300):  # in one block and in several
        out = dc.find_leaks(df, bench, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want | two
    exact = {(r.doc_id, r.item_id): r for r in out if r.doc_id % 10 == 0 and 1000 <= r.doc_id < 2000}
    assert all(r.score == 1.0 and r.end_word - r.first_word >= 20 for r in exact.values())
    left = dc.without_leaks(df, bench, block_chars=300)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want | two}


def test_many_equal_copies_of_an_edited_item(spark):
    """Every fifth word replaced leaves 16 of 38 n-grams, which all copies share; a verbatim copy doesn't change what is found."""
    words = [f"w{i}" for i in range(40)]
    copy = " ".join(f"new{i}" if i % 5 == 2 else w for i, w in enumerate(words))
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    for n, more in ((1, []), (2, []), (100, []), (100, [(500, " ".join(words))])):
        docs = [(i, f"{brute.prose(i, 30)} {copy} {brute.prose(900 + i, 30)}") for i in range(n)] + more
        df = spark.createDataFrame([*docs, (999, " ".join(words[:4]))], "doc_id long, text string")
        assert {r.doc_id for r in dc.find_leaks(df, bench).collect()} == {d for d, _ in docs}
        assert [r.doc_id for r in dc.without_leaks(df, bench).collect()] == [999]


def test_passages_of_long_items(spark):
    words = [f"w{i}" for i in range(600)]
    bench = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(f"v{i % 7}" for i in range(600)))], "item_id long, text string")
    parts = {1: words[100:400], 2: words[:50], 3: words[-50:], 4: words[200:249], 5: words[10:59] + ["else"] + words[60:109], 6: [f"v{i % 7}" for i in range(3, 63)]}
    docs = [(d, " ".join([*["before"] * 5, *p, *["after"] * 3])) for d, p in parts.items()]
    docs += [(10 + i, " ".join(words[100:400])) for i in range(30)] + [(50, " ".join(words[300:350] + words[:300]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in dc.find_leaks(df, bench).collect()}
    want = {(1, 0): (0.5, 5, 305), (2, 0): (50 / 600, 5, 55), (3, 0): (50 / 600, 5, 55), (6, 1): (0.1, 5, 65), (50, 0): (0.5, 50, 350)}
    assert rows == want | {(10 + i, 0): (0.5, 0, 300) for i in range(30)}
    assert {r.doc_id for r in dc.without_leaks(df, bench).collect()} == {4, 5}


def leaked(item, text, min_score=0.6):
    """Whether the item leaked, by the whole matrix or a passage."""
    a, b = dc.words_of(item), dc.words_of(text)
    if not a:
        return False
    places = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x, y = np.array([places[w] for w in a]), np.array([places.get(w, -1) for w in b])
    if len(b) and dc.align(x, y)[0] >= min_score * dc.MATCH * len(a):
        return True
    joined = f" {' '.join(b)} "
    return any(f" {' '.join(a[i : i + dc.PASSAGE])} " in joined for i in range(len(a) - dc.PASSAGE + 1))


def test_no_copy_is_lost():
    """All that the whole matrix accepts, on items of any length with any edits, however frequent their seeds are."""
    r = random.Random(21)
    hits = 0
    for _ in range(400):
        words = [r.choice("abcdefghij") if r.random() < 0.3 else f"w{r.randrange(60)}" for _ in range(r.randrange(0, 30))]
        items = [(0, " ".join(words)), (1, " ".join(words[:4])), (2, "lone"), (3, None if r.random() < 0.5 else "")]
        block = dc.Block.of(items, 0.6)
        block = block.rare(np.array([r.randrange(100) for _ in block.grams], np.int64))
        copy = list(words)
        how = r.randrange(4)
        if how == 0:
            copy = [x for i, w in enumerate(words) for x in ([w, "put"] if i % 2 else [w])]
        elif how == 1:
            copy = ["new" if i % 3 == 2 else w for i, w in enumerate(words)]
        elif how == 2:
            copy = edited(" ".join(words), 0.5, r.random()).split()
        text = " ".join([*(r.choice("abcdefghij") for _ in range(r.randrange(40))), *copy, *(f"w{r.randrange(60)}" for _ in range(r.randrange(9)))])
        want = {k for k, item in items if leaked(item or "", text)}
        assert {m[0] for m in dc._matches(block, text)} == want
        hits += len(want)
    assert hits > 200


def test_pairs_that_the_score_guarantees():
    for words, text in ((24, lambda i, w: [w, "put"] if i % 2 else [w]), (24, lambda i, w: ["new"] if i % 4 == 3 else [w]), (8, lambda i, w: [w, "put"] if i % 2 else [w])):
        item = [f"w{i}" for i in range(words)]
        block = dc.Block.of([(0, " ".join(item))], 0.6)
        copy = " ".join(x for i, w in enumerate(item) for x in text(i, w))
        assert leaked(" ".join(item), copy) and [m[0] for m in dc._matches(block.rare(np.arange(len(block.grams))), copy)] == [0]


def test_block_memory():
    rows = [(i, brute.prose(i, 100, 3000)) for i in range(30_000)]
    tracemalloc.start()
    block = dc.Block.of(rows, 0.6)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    chars = sum(len(t) for _, t in rows)
    assert chars > 15e6 and held < 100e6 and peak < 350e6
    assert len(block.places) > 2e6


def test_long_text(spark):
    text = f"{brute.prose(1, 400_000)} {ITEMS[5][1]} {brute.prose(2, 400_000)}"
    docs = spark.createDataFrame([(1, text), (2, brute.prose(3, 50))], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in dc.find_leaks(docs, bench).collect()] == [(1, 5, 1.0)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.find_leaks(docs.limit(0), bench).count() == 0 and dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.without_leaks(docs, bench.limit(0)).count() == 1
    named = spark.createDataFrame([("a", ITEMS[0][1])], "doc_id string, text string")
    assert [(r.doc_id, r.item_id) for r in dc.find_leaks(named, bench).collect()] == [("a", 0)]


def test_tables(spark, sf_dir):
    """Against Smith-Waterman of every item with every document."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items, texts = bench.collect(), docs.collect()
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for b in items for w in dc.words_of(b.text)))}
    want = set()
    for d in texts:
        ids = np.array([vocabulary.get(w, -1) for w in dc.words_of(d.text)], np.int64)
        for b in items:
            item = np.array([vocabulary[w] for w in dc.words_of(b.text)], np.int64)
            # Fewer words of it than the score takes can't give the score.
            if len(item) and np.isin(item, ids).sum() >= 0.6 * len(item) and dc.align(item, ids)[0] >= 0.6 * dc.MATCH * len(item):
                want.add((d.doc_id, b.item_id))
    verbatim = {(d.doc_id, b.item_id) for d in texts for b in items if b.text in d.text}
    found = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    assert found == want and verbatim <= want
