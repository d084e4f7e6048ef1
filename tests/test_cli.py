import json

import pytest
from tests.test_api import write

from docloom.__main__ import main
from docloom.functions.maps import probe_record


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    write(path)
    return path


def run(spark, capsys, *args):
    assert main([*map(str, args)], spark) == 0
    return capsys.readouterr().out


def test_tables(spark, capsys, folder):
    rows = [json.loads(x) for x in run(spark, capsys, "outline", f"file://{folder}/a.pdf").splitlines()]
    assert [r["title"] for r in rows] == ["One", "Süb", "Two"]
    rows = [json.loads(x) for x in run(spark, capsys, "search", f"file://{folder}/a.pdf", "PAGE 2").splitlines()]
    assert [(r["part"], r["hits"]) for r in rows] == [(1, 1)]
    rows = [json.loads(x) for x in run(spark, capsys, "info", f"file://{folder}/sub", "--password", "u").splitlines()]
    assert rows[0]["n_pages"] == 3 and rows[0]["level"] == "user"
    assert run(spark, capsys, "check", f"file://{folder}/a.pdf") == ""


def test_probe(spark, capsys, folder):
    from pyspark.sql import functions as F

    text = run(spark, capsys, "probe", f"file://{folder}/a.pdf")
    r = spark.createDataFrame([(text,)], "t string").select(probe_record(F.col("t")).alias("r")).first().r
    assert r.opened and r.pages == 4 and r.rendered == 4 and r.warnings == {}


def test_files(spark, capsys, folder, tmp_path):
    out = run(spark, capsys, "render", f"file://{folder}/sub", "--password", "u", "--out", tmp_path).splitlines()
    assert len(out) == 3
    assert len(run(spark, capsys, "render", f"file://{folder}/a.pdf", "--out", tmp_path, "--dpi", 36).splitlines()) == 4
    assert len(run(spark, capsys, "pdf", f"file://{folder}", "--out", tmp_path).splitlines()) == 2 and (tmp_path / "c.pdf").read_bytes().startswith(b"%PDF-")
