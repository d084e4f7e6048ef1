import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """A value as both engines give it."""
    import decimal
    import math

    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value.is_integer() else value
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    """Rows sorted, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_rows(duck):
    def check(df, sql):
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        want = rows_of(names, got.fetchall())
        have = rows_of(df.columns, [tuple(r) for r in df.collect()])
        assert sorted(df.columns) == sorted(names)
        assert len(have) == len(want)
        off = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
        assert not off, f"{len(off)} rows differ, as {off[:3]}"
        assert want, "an oracle without rows shows nothing"

    return check
