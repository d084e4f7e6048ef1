"""Lookups, closures and groupings against plain versions."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from docloom.checkpoints import shared_dir
from docloom.operators import closure, grouping, lookup


def test_asof(spark):
    r = random.Random(1)
    ranges = [(d, k, None if k % 7 == 0 else f"{d}{k}") for d in "ab" for k in sorted(r.sample(range(50), 8))]
    points = [(d, r.randrange(-5, 60), i) for i, d in enumerate(r.choices("abc", k=120))]
    got = lookup.asof(spark.createDataFrame(points, "doc string, at int, n int"), spark.createDataFrame(ranges, "doc string, at int, label string"), ["doc"], "at", "label")
    assert got.columns == ["doc", "at", "n", "label"]
    want = {(d, at, n, max(((k, v) for e, k, v in ranges if e == d and k <= at), key=lambda x: x[0], default=(0, None))[1]) for d, at, n in points}
    assert {tuple(x) for x in got.collect()} == want


def test_ranges_and_intervals(spark):
    codes = spark.createDataFrame([(c,) for c in range(-2, 40)], "code long")
    found = lookup.range_lookup(codes, "code", spark.createDataFrame([(0, 9, "a"), (10, 10, "b"), (20, 29, "c")], "lo long, hi long, value string"))
    assert {x.code: x.value for x in found.collect()} == {c: "a" if 0 <= c <= 9 else "b" if c == 10 else "c" if 20 <= c <= 29 else None for c in range(-2, 40)}
    r = random.Random(2)
    spans = [(d, float(x), float(x + r.randrange(1, 6)), i) for i, (d, x) in enumerate((r.choice("ab"), r.randrange(0, 60)) for _ in range(150))]
    areas = [(d, float(x), float(x + r.randrange(0, 9))) for d, x in ((r.choice("abc"), r.randrange(0, 60)) for _ in range(8))]
    hit = lookup.intervals_hit(spark.createDataFrame(spans, "doc string, x0 double, x1 double, n int"), spark.createDataFrame(areas, "doc string, a0 double, a1 double"), ["doc"], "x0", "x1")
    assert {x.n for x in hit.collect()} == {n for d, x0, x1, n in spans if any(d == e and a0 < x1 and x0 < a1 for e, a0, a1 in areas)}


def test_empty_spans_and_null_keys_of_intervals(spark):
    spans = [(d, float(x), float(x + n), 10 * x + n) for d in ("a", None) for x in range(12) for n in (0, 1, 3)]
    areas = [("a", 4.0, 7.0), ("a", 9.0, 9.0), ("a", 10.0, 11.0), (None, 0.0, 9.0)]
    hit = lookup.intervals_hit(spark.createDataFrame(spans, "doc string, x0 double, x1 double, n int"), spark.createDataFrame(areas, "doc string, a0 double, a1 double"), ["doc"], "x0", "x1")
    assert sorted(x.n for x in hit.collect()) == sorted(n for d, x0, x1, n in spans if d and any(d == e and a0 < x1 and x0 < a1 for e, a0, a1 in areas))


def test_redacted_spans_of_odd_documents(spark, tmp_path):
    """Empty texts, empty words where an area starts, and documents without a number, as the SQL has them."""
    import duckdb

    from docloom import plans

    texts = ["", " ", "a b", "one  two  three   ", "ab cd  ef " * 30, "x" * 9 + " " * 2 + "y" * 9, None]
    rows = [(i if i != 2 else None, t, len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(plans.ORACLES["redact_spans"]).fetchall())
    assert sorted(tuple(r) for r in plans.QUERIES["redact_spans"](spark, str(tmp_path)).collect()) == want


def test_overlay_and_newest(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(2, "B", False), (3, None, True), (4, "d", False), (9, None, True)], "k int, v string, deleted boolean")
    assert {tuple(x) for x in lookup.overlay(base, changes, "k").collect()} == {(1, "a"), (2, "B"), (4, "d")}
    rows = spark.createDataFrame([(1, 0, "x"), (1, 2, "y"), (1, 1, "z"), (2, None, "n")], "num int, rev int, v string")
    assert {tuple(x) for x in lookup.newest(rows, ["num"], ["rev"]).collect()} == {(1, 2, "y"), (2, None, "n")}


def test_similarity(spark):
    words = lambda d: spark.createDataFrame([(k, w) for k, ws in d.items() for w in ws.split()], "k string, word string")
    out = lookup.multiset_similarity(words({"a": "x x y", "b": "p"}), words({"a": "x y y z", "c": "q"}), ["k"])
    assert {r.k: r.similarity for r in out.collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}


def test_closures(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(60)]

    def reach(avoid=()):
        seen, work = set(), [0] if 0 not in avoid else []
        while work:
            n = work.pop()
            if n not in seen:
                seen.add(n)
                work += [b for a, b in edges if a == n and b not in avoid]
        return seen

    e = spark.createDataFrame(edges, "src int, dst int")
    start = spark.createDataFrame([(0,)], "node int")
    assert {x.node for x in closure.reachable(e, start).collect()} == reach()
    some = sorted(reach() - {0})[:3]
    avoid = spark.createDataFrame([(n,) for n in some] or [(99,)], "node int")
    assert {x.node for x in closure.reachable(e, start, avoid).collect()} == reach(some)
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "node int, target int")
    ends = {x.node: (x.end, x.hops) for x in closure.follow(links, spark.createDataFrame([(1,), (4,), (5,)], "node int"), 4).collect()}
    assert ends[1] == (3, 2) and ends[4] == (4, 0) and ends[5][1] == 4


def test_inherit(spark):
    tree = spark.createDataFrame([("r", None, 0, "top", None), ("a", "r", 1, None, "x"), ("b", "r", 0, "own", None), ("c", "a", 0, None, None), ("loop1", "loop2", 0, "l", None), ("loop2", "loop1", 0, None, None)], "node string, parent string, seq int, label string, kind string")
    rows = {x.node: x for x in closure.inherit(tree, ["label", "kind"]).collect()}
    assert set(rows) == {"r", "a", "b", "c"} and rows["c"].label == "top" and rows["c"].kind == "x" and rows["b"].label == "own" and rows["c"].depth == 2
    assert sorted(rows, key=lambda n: rows[n].path) == ["r", "b", "a", "c"]


def test_text_lines(spark):
    glyphs = [("d", 0, i, x, y, 0.0, 10.0, x + 5, t) for i, (x, y, t) in enumerate([(0.0, 100.0, "a"), (5.0, 100.0, "b"), (0.0, 88.0, "c"), (5.0, 88.4, "d"), (0.0, 60.0, "e")])]
    rows = grouping.text_lines(spark.createDataFrame(glyphs, "doc_id string, page_index int, seq int, x double, y double, angle double, size double, pen_x double, text string"))
    assert [r.line for r in rows.orderBy("seq").collect()] == [0, 0, 1, 1, 2]
    lines = rows.groupBy("doc_id", "page_index", "line").agg(F.min("y").alias("y"), F.max("size").alias("size"))
    assert [r.block for r in grouping.text_blocks(lines).orderBy("line").collect()] == [0, 0, 1]


def test_shared_dir(spark):
    assert shared_dir(spark).startswith("file:///")


@pytest.mark.parametrize("margins", [[3.0, 5.0], [-2.0, 4.0], [-2.0, -6.0], [0.0]])
def test_margins(spark, margins):
    out = grouping.collapse_margins(spark.createDataFrame([("a", m) for m in margins], "k string, m double"), ["k"], "m").first()
    assert out.m == max([0, *margins]) + min([0, *margins])


def test_reachable_is_never_cut_silently(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert sorted(x.node for x in closure.reachable(chain, start).collect()) == list(range(6))
    assert closure.reachable(chain, start, rounds=5).count() == 6
    with pytest.raises(RuntimeError):
        closure.reachable(chain, start, rounds=4)
    assert inspect.signature(closure.reachable).parameters["rounds"].default is None
