import re
from collections import Counter

import pytest
from tests.llm import brute

from docloom.llm import queries, quality_rules

TEXTS = [None, "", " \n\t", "word", "a b c a b c", "x " * 60, brute.prose(1, 80), brute.prose(2, 60).upper(), "\n".join(["the same line"] * 30 + ["another line"]), "é# ü$ |" * 40, "w" * 500 + " " + brute.prose(3, 60), brute.prose(4, 70).replace(" ", "!! "), "a\x0bb\x0cc\rd\x85e\xa0f \x1cg"]


def plain(text):
    words = brute.WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    t = quality_rules.Text(text.encode() if text is not None else None)
    assert tuple(getattr(t, f) for f in FEATURES) == plain(text)


def test_order_has_no_bearing(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS * 3)] + [(None, TEXTS[6], 1)], "doc_id long, text string, kept int")
    out = quality_rules.judge(docs, features=FEATURES).collect()
    back = quality_rules.judge(docs, rules=quality_rules.RULES[::-1], sample_rows=1).collect()
    assert len(out) == len(TEXTS) * 3 + 1
    assert {r.doc_id: r.kept for r in out} == {r.doc_id: r.kept for r in back}
    for r in out:
        text = TEXTS[r.doc_id % len(TEXTS)] if r.doc_id is not None else TEXTS[6]
        assert tuple(r[f] for f in FEATURES) == plain(text)
        rejecting = {x.name for x in quality_rules.RULES if x.rejects(quality_rules.Text((text or "").encode()))}
        assert r.kept == (not rejecting) and (r.rejected_by in rejecting or r.kept)
    assert any(r.kept for r in out) and not all(r.kept for r in out)


def test_cascade_order():
    rules = quality_rules.RULES[:4]
    found = quality_rules.order([(rules[0], 1.0, 0.5), (rules[1], 0.1, 0.2), (rules[2], 0.3, 0.0), (rules[3], 0.2, 0.0)])
    assert [r.name for r in found] == [rules[i].name for i in (1, 0, 3, 2)]


def test_empty(spark):
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql(spark, sf_dir, same_rows):
    same_rows(queries.op1_quality_rules(spark, sf_dir), queries.OP1_SQL)


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_rules.judge(docs, features=["n_words"]).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and r.n_words >= 50)
    assert not any(r.kept for r in rows if r.quality == 0)
