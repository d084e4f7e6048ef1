import time

from pyspark.sql import functions as F
from tests.test_archives import book, fixed, zipped
from tests.test_pdf import sample

from docloom import streaming
from docloom.api import Documents
from docloom.operators import files as probes
from docloom.operators import report
from docloom.sources.pdf import tables as pdf

HTML = b"<!DOCTYPE html><html><head><title>Page</title><style>p{}</style></head><body><h1>Page one</h1><p>more <b>page</b> text</p><script>page()</script></body></html>"


def write(folder):
    for name, body in (("a.pdf", sample().finish()), ("sub/b.PDF", sample(3).finish(passwords=("u", "o"))), ("c.epub", book()), ("d.xps", fixed()), ("e.html", HTML), ("f.zip", zipped({"x": b""})), ("g.txt", b"page")):
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(body)


def test_documents(spark, tmp_path):
    write(tmp_path)
    docs = Documents.of(spark, f"file://{tmp_path}")
    end = lambda r: r.doc_id.rsplit("/", 1)[1]
    assert {end(r): r.kind for r in docs.table("kinds").collect()} == {"a.pdf": "pdf", "b.PDF": "pdf", "c.epub": "zip", "d.xps": "zip", "e.html": "html", "f.zip": "zip", "g.txt": None}
    hits = {}
    for r in docs.search("page").collect():
        hits[end(r)] = hits.get(end(r), 0) + r.hits
    assert hits == {"a.pdf": 4, "e.html": 2}
    opened = Documents(docs.files, "u")
    assert {end(r) for r in opened.table("text_lines").collect()} == {"a.pdf", "b.PDF"}
    labels = {(end(r), r.page_index): r.label for r in docs.page_labels().collect()}
    assert [labels["a.pdf", i] for i in range(4)] == ["i", "ii", "p-5", "p-6"]
    views = docs.register("t_")
    assert spark.sql("SELECT count(*) FROM t_outline").first()[0] == 3 and "t_entries" in views
    assert pdf.files(spark, f"file://{tmp_path}").count() == 2


def test_arriving_files(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write(source)
    run = lambda: streaming.extract(streaming.arriving_files(spark, str(source), "*.pdf"), lambda f: pdf.read(f, "text_lines"), str(out), str(tmp_path / "cp")).awaitTermination(60)
    run()
    assert spark.read.parquet(str(out)).count() == 12
    (source / "late.pdf").write_bytes(sample(5).finish())
    run()
    run()
    assert spark.read.parquet(str(out)).count() == 12 + 15


def test_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = streaming.sessions(events, "6 hours").collect()
    assert sum(r.events for r in rows) == events.count() and time.time() > 0


def test_probe_reports(spark):
    record = lambda n, opened, rendered, extra="": f"probe 1\nfile {n}\nopened {opened}\npages 2\nrendered {rendered}\n{extra}ms 5\ndone\n"
    rows = [("x", "1", record(1, "yes", 2), False), ("x", "2", record(2, "yes", 2, "cap jbig2\nwarn font 3\n"), False), ("x", "3", record(3, "no broken", 0, "cap jpx\n"), False), ("x", "4", "probe 1\n", False), ("y", "5", None, True)]
    files = probes.results(spark.createDataFrame(rows, "corpus string, path string, record string, late boolean"), timed_out_col="late")
    assert [r.outcome for r in files.orderBy("path").collect()] == ["passed", "passed", "failed", "crashed", "timed_out"]
    assert files.where(probes.degraded(F.col("warnings"))).count() == 1
    bars = probes.read_ratchet(probes.ratchet(files)).orderBy("corpus").collect()
    assert [tuple(r) for r in bars] == [("x", 4, 2), ("y", 1, 0)]
    now = spark.createDataFrame([("x", 8, 4), ("z", 1, 1)], "corpus string, total long, passed long")
    before = probes.read_ratchet(probes.ratchet(files))
    assert {r.corpus: r.verdict for r in report.gate(before, now).collect()} == {"x": "holds", "y": "missing", "z": "new"}
    assert probes.report_json(files).where("path = '2'").first().json.startswith('{"corpus":"x","path":"2","outcome":"passed"')
    lock = spark.createDataFrame([("# c",), ("",), ("pdfjs https://x abc 123 # note",)], "value string")
    assert [tuple(r) for r in probes.lock_entries(lock).collect()] == [("pdfjs", "https://x", "abc", "123")]
