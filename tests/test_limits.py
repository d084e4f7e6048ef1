"""Limits and damage are told, not hidden."""

import pytest

from docloom.operators import closure
from docloom.sources.pdf import tables
from docloom.sources.pdf.content import Interpreter
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.writer import Builder


def test_deep_trees(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 0, "a" if i == 0 else None) for i in range(67)], "node int, parent int, seq int, x string")
    out = closure.inherit(chain, ["x"])
    assert out.count() == 67 and out.where("x = 'a'").count() == 67
    with pytest.raises(RuntimeError):
        closure.inherit(chain, ["x"], levels=3)


def test_rows_that_end_early():
    def broken(doc):
        yield {"title": "first"}
        raise ValueError("damaged here")

    b = Builder()
    b.page()
    rows = list(tables._safe(b.finish(), broken, True, ""))
    assert rows == [{"title": "first"}, {"error": "ValueError: damaged here"}]


def test_operators_after_the_limit():
    b = Builder()
    b.page()
    b.raw(b"q Q " * 50)
    doc = Document(b.finish())
    run = Interpreter(doc)
    run.budget = 10
    page = doc.pages()[0][1]
    run.run(doc.contents(page), page.get("Resources"))
    assert doc.warnings.found == {"operators after the limit": 1}


def test_error_column(spark):
    b = Builder()
    b.page()
    b.text(10, 10, "x")
    df = spark.createDataFrame([(1, b.finish()), (2, b"junk")], "doc_id long, content binary")
    for name in tables.TABLES:
        out = tables.read(df, name)
        assert out.columns[-1] == "error" and out.where("error is not null").count() == 0
