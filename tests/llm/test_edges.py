"""Nulls, repeated rows, clashing names, very long texts and empty tables, for the stages and the operators that other tests leave."""

import os
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_sketches import components

from docloom.llm import chat_format, mixing, quality_classifier, quality_rules, simhash, url_filter
from docloom.llm.common import drop_cut, unused

CLASHING = ("__id", "__hash", "__times", "__n", "__key", "__own", "__copy", "__fp", "__salt", "__many", "id", "fp", "root", "size", "source_id", "row_hash", "times", "one", "text_", "item", "y")


def left_in(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    return {x for x in os.listdir(folder) if x.startswith("docloom-")}


def odd_documents(spark):
    text = brute.prose(1, 80)
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " more", "en", None, 5), (3, None, None, "b", None), (None, "", "en", "a", 0), (None, text, "en", "a", 5), (4, "  \n", "en", "b", 3), (5, brute.prose(2, 90), "fr", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd_documents(spark)
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    drop_cut(out)
    if name != "token_output":
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    if name == "decontamination":
        assert len(rows) == docs.count()
    elif name == "simhash_dedup":
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        root, first = components([t for _, t in texts]), {}
        for k, (i, _) in enumerate(texts):
            first.setdefault(root[k], i)
        assert sorted(ids, key=repr) == sorted(first.values(), key=repr) and None in ids
    elif name == "source_mixing":
        assert {r.source for r in rows} >= {"a", None} and max(ids.count(i) for i in (2, 5)) <= 2
    elif name == "token_output":
        assert len(rows) == docs.count() and [r.n_tokens for r in rows].count(1) == 3
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.count() == 0
    drop_cut(empty)


def test_nothing_is_left_behind(spark, sf_dir):
    before = left_in(spark)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    left = {x.split("-")[1] for x in left_in(spark) - before}
    assert left == {"tokens", "token_output"}  # the files, and the last table
    for make in (simhash.without_copies, simhash.without_near_copies, mixing.mixed):
        before = left_in(spark)
        got = make(odd_documents(spark))
        got.count()
        drop_cut(got)
        assert left_in(spark) == before


def test_maps_inside_columns(spark):
    docs = spark.sql("select 1L as doc_id, 'a b' as text, 'x' as source, struct(map('k', id) as m, array(map('k', id)) as a) as deep from range(3)")
    assert mixing.mixed(docs).count() >= 3


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "__ID int, __id_ int")
    assert unused(df, "id", "x") == ["__id__", "__x"]


LONG = brute.prose(3, 400_000)


def test_long_texts_are_judged_whole(spark):
    docs = spark.createDataFrame([(1, LONG + " tail tail tail tail tail tail"), (2, LONG)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.judge(docs, features=["n_words", "word_chars", "n_repeat_words"]).collect()}
    assert rows[1].n_words == 400_006 and rows[2].n_words == 400_000 and rows[1].n_repeat_words >= rows[2].n_repeat_words + 5
    assert rows[2].word_chars == sum(map(len, LONG.split()))


def test_long_turns_and_urls(spark):
    template = chat_format.ChatTemplate()
    talk = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "</s>")], "conv_id long, turn int, role string, text string")
    out = chat_format.format_conversations(chat_format.format_turns(talk, template), template)
    back = out.select(chat_format.read_back(F.col("formatted"), template).alias("b")).first().b
    assert [(t.role, t.text) for t in back] == [("user", LONG), ("assistant", LONG + "</s>")]
    pages = spark.createDataFrame([(1, "http://a.net/" + "x" * 1_000_000), (2, "http://" + "a." * 100_000 + "net/"), (3, None)], "page_id long, url string")
    rows = {r.page_id: (r.verdict, len(r.path)) for r in url_filter.judge(pages, [("net", "/", "block")]).collect()}
    assert rows == {1: ("block", 1_000_001), 2: ("block", 1), 3: ("allow", 0)}


def test_long_documents_are_mixed(spark):
    docs = spark.createDataFrame([(1, LONG, "a"), (2, "b c", "b")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert rows[1].size == 400_000 and rows[2].size == 2 and max(r.times for r in rows.values()) <= 2


def test_classifier_against_plain_counts(spark):
    """Log-count ratios as their definition gives them, and the model's objective against random steps from its weights."""
    texts = [(i, brute.prose(i, 30, 40) + (" good fine" if i % 2 else " BAD!! #$%"), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    features = quality_classifier.Features()
    slots = [features(t.encode()) for _, t, _ in texts]
    size = len(model.ratio)
    counts = np.ones((2, size))
    for s, (_, _, y) in zip(slots, texts, strict=True):
        counts[y, s] += 1
    seen = counts.sum(0) > 2
    want = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
    assert np.allclose(model.ratio, want)
    y = np.array([2 * y - 1 for _, _, y in texts])
    rows = np.zeros((len(texts), size + 1))
    for i, s in enumerate(slots):
        rows[i, s] = want[s] / np.sqrt((want[s] ** 2).sum())
        rows[i, -1] = 1.0
    used = np.flatnonzero(rows.any(0))
    w = np.append(np.divide(model.weight, model.ratio, out=np.zeros(size), where=model.ratio != 0), model.bias)
    cost = lambda w: 0.5 * w[used] @ w[used] + np.maximum(0, 1 - y * (rows[:, used] @ w[used])).sum()
    best, random = cost(w), np.random.default_rng(5)
    for step in (1e-3, 1e-2, 0.1):
        for _ in range(100):
            off = np.zeros(size + 1)
            off[used] = random.normal(0, step / np.sqrt(len(used)), len(used))
            assert cost(w + off) >= 0.99 * best
