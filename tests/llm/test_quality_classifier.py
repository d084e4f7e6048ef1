import numpy as np
from pyspark.sql import functions as F
from tests.llm import brute

from docloom.llm import quality_classifier as qc
from docloom.llm import queries


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op4_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.97


def test_held_out_labels_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(queries.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = queries.quality_model(docs, labels), queries.quality_model(docs, turned)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_descent_finds_the_margin():
    rows = [(np.array([0, 1]), np.array(v)) for v in ([2.0, 1.0], [1.5, 1.0], [-1.0, 1.0], [-3.0, 1.0])]
    w = qc.dual_coordinate_descent(rows, np.array([1.0, 1, -1, -1]), np.full(4, 1e3), 2, epochs=2000)
    assert np.allclose(w, [0.8, -0.2], atol=1e-2)


def test_features_are_of_whole_texts():
    f = qc.Features()
    a = brute.prose(1, 50).encode()
    late = b"q" * (qc._BLOCK + 5) + b" " + a
    assert set(f(a)[:-1]) - set(f(late)) == set() or len(set(f(a)) - set(f(late))) <= 3
    assert not f(None).size and not f(b"").size and f(b"x").size


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (2, "BAD!! BAD!!", 2), (3, None, 3), (4, "", 4), (None, "x", 5), (2, "BAD!! BAD!!", 6)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (3, 0), (4, None), (77, 1)], "doc_id long, quality int")
    model = qc.fit(docs, labels)
    rows = {(r.doc_id, round(r.score, 6)) for r in qc.score(docs, model).collect()}
    assert len(rows) == 5 and {i: s >= 0.5 for i, s in rows}[1] and not {i: s >= 0.5 for i, s in rows}[2]
    assert [r.score for r in qc.keep(docs, model).orderBy("score").collect()][0] == 1
    assert qc.score(docs.limit(0), model).count() == 0
    for part, want in ((labels.limit(0), 0.5), (labels.where("doc_id = 1"), 1.0), (labels.where("doc_id = 2"), 0.0)):
        assert {round(r.score, 6) for r in qc.score(docs, qc.fit(docs, part)).collect()} == {want}
    assert {r.score for r in qc.score(docs, qc.fit(docs.limit(0), labels)).collect()} == {0.5}
