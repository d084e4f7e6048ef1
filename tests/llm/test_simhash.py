import random

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from docloom.llm import common, simhash


@pytest.mark.parametrize("text", [None, "", " \t\n\x0b\x0c\r", "One", "one TWO", "a b c", "ÀÉ Ab\x85c d e f", "x y z " * 50, brute.prose(1, 300)])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute.simhash(text)


def test_fingerprint_of_a_long_text():
    text = brute.prose(2, 70_000)
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    found = dict(common.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = brute.union_find(range(500), [x for x in links if None not in x])
    assert all(found.get(n, n) == want[n] for n in want)


@pytest.mark.parametrize("crowd", [512, 3])
def test_links(spark, crowd):
    """Both ways, by pairs and by balls, connect the same fingerprints as all pairs compared."""
    r = random.Random(4)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = r.getrandbits(64)
        fps.add(centre)
        for _ in range(12):
            fps.add(centre := centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(1, 5))}))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd).collect()
    assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3 for a, b in found)
    want = brute.union_find(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3])
    have = brute.union_find(signed, found)
    assert have == want and len(set(want.values())) < len(signed)


ROWS = [
    (5, "alpha beta gamma delta epsilon zeta eta theta", 1),
    (3, "Alpha BETA gamma delta epsilon zeta eta theta", 2),
    (9, None, 3),
    (8, "", 4),
    (2, "nothing like the others at all, truly", 5),
    (2, "nothing like the others at all, truly", 5),
    (2, "the same id with another text here", 6),
    (None, "no id on this one whatever it says", 7),
    (None, "alpha beta gamma delta epsilon zeta eta theta", 8),
]


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string, fp int")).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.component_id) for r in rows} == {(5, 3), (3, 3), (9, 8), (8, 8), (2, 2), (None, None), (None, 3)}
    assert sorted(r.fp & ((1 << 64) - 1) for r in rows) == sorted(brute.simhash(t) for _, t, _ in ROWS)


def test_without_copies(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, fp int")
    out = simhash.without_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.fp for r in out.collect())) == [4, 5, 6, 7, 8]
    plain = simhash.without_copies(docs.where("doc_id > 2"))
    assert sorted(r.doc_id for r in plain.collect()) == [3, 8]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.without_copies(docs).count() == 0


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: brute.simhash(t) for d, t in texts.items()}
    ids = sorted(fps)
    want = brute.union_find(ids, [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    have = simhash.near_duplicates(docs).select("doc_id", F.hex("fp").alias("fp"), "component_id").collect()
    assert {r.doc_id: r.component_id for r in have} == want
    assert all(int(r.fp, 16) == fps[r.doc_id] for r in have)
