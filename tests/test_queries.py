"""Each query against its SQL, and those without SQL for rows."""

import hashlib
import re

import pytest

from docloom import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, same_rows, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLES:
        same_rows(df, plans.ORACLES[name])
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "hits", "lines_hit"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_line_of_whole_texts(spark, sf_dir):
    rows = {r.doc_id: (r.chars, r.digest) for r in plans.QUERIES["one_line_whole_texts"](spark, sf_dir).collect()}
    lines = {r.doc_id: re.sub(r"[\x00-\x1f\x7f]", " ", r.text).strip(" ") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows == {k: (len(x), hashlib.md5(x.encode()).hexdigest()) for k, x in lines.items()}
    assert max(map(len, lines.values())) > 200
