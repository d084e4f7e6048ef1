import pytest
from pyspark.sql import functions as F

from docloom.operators import editing
from docloom.sources.pdf import redact
from docloom.sources.pdf.content import Interpreter, lines
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref, Stream
from docloom.sources.pdf.writer import Builder, deflated, update


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(d, i, f"{d}{i}", 90 * i) for d, n in (("a", 4), ("b", 2)) for i in range(n)], "doc_id string, page_index int, name string, rotation int")


def names(df, doc="a"):
    rows = sorted(df.where(F.col("doc_id") == doc).collect(), key=lambda r: r.page_index)
    assert [r.page_index for r in rows] == list(range(len(rows)))
    return [r.name for r in rows]


@pytest.mark.parametrize(("at", "to"), [(0, 3), (3, 0), (1, 2), (2, 1), (1, 1), (0, 9), (-1, 0)])
def test_move(pages, at, to):
    want = ["a0", "a1", "a2", "a3"]
    if 0 <= at < 4 and 0 <= to < 4:
        want.insert(to, want.pop(at))
    out = editing.move_page(pages, at, to)
    assert names(out) == want and sorted(names(out, "b")) == ["b0", "b1"]


def test_pages(spark, pages):
    some = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "doc_id string, page_index int")
    assert names(editing.delete_pages(pages, some)) == ["a0", "a2", "a3"] and names(editing.keep_pages(pages, some)) == ["a1"]
    assert names(editing.insert_page(pages, 2, 100, 200)) == ["a0", "a1", None, "a2", "a3"]
    assert names(editing.insert_page(pages, 99, 1, 1), "b") == ["b0", "b1", None]
    assert sorted(r.rotation for r in editing.rotate_pages(pages.where("doc_id = 'a'"), F.lit(270)).collect()) == [0, 90, 180, 270]


FIELDS = [("d", "t", "text", "old", "dflt", 0, [], 5), ("d", "ro", "text", "x", None, 1, [], None), ("d", "c", "combo", None, "a", 0, ["a", "b"], None), ("d", "g.x", "radio", "Off", None, 0, [], None), ("d", "g.y", "radio", "y", None, 0, [], None), ("d", "k", "checkbox", "Off", None, 0, [], None), ("e", "t", "text", "keep", None, 0, [], None)]


def test_fields(spark):
    f = spark.createDataFrame([(*r, i, 1 if r[1] == "c" else None) for i, r in enumerate(FIELDS)], "doc_id string, name string, kind string, value string, default string, flags long, options array<string>, max_len int, seq int, calculated int")
    values = lambda df: {(r.doc_id, r.name): r.value for r in df.collect()}
    new = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, name string, new string")
    out, refused = editing.fill_fields(f, new(("d", "t", "abcde"), ("d", "c", "b")))
    assert values(out)["d", "t"] == "abcde" and values(out)["d", "c"] == "b" and refused.count() == 0 and out.columns == f.columns
    out, refused = editing.fill_fields(f, new(("d", "t", "abcdef"), ("d", "c", "b"), ("d", "a", "?"), ("e", "t", "n")))
    assert values(out)["d", "c"] is None and values(out)["e", "t"] == "n" and [tuple(r) for r in refused.collect()] == [("d", "a", "no such field")]
    assert editing.fill_fields(f, new(("d", "ro", "y")))[1].count() == editing.fill_fields(f, new(("d", "c", "z")))[1].count() == 1
    assert {k: v for k, v in values(editing.select_radio(f, "g", "x")).items() if k[1].startswith("g")} == {("d", "g.x"): "x", ("d", "g.y"): "Off"}
    assert values(editing.set_checkbox(f, "k", True))["d", "k"] == "Yes"
    reset = values(editing.reset_form(f))
    assert reset["d", "t"] == "dflt" and reset["d", "ro"] is None and reset["d", "g.y"] == "Off"
    assert [r.name for r in editing.calculation_order(f.where("doc_id = 'd'")).orderBy("turn").collect()][:2] == ["c", "t"]


def shown(doc, page=0):
    run = Interpreter(doc)
    d = doc.pages()[page][1]
    run.run(doc.contents(d), d.get("Resources"))
    return run


def sample():
    b = Builder()
    b.page()
    b.text(100, 700, "keep secret keep", 10)
    b.raw(b"BT /F1 10 Tf 100 650 Td [(tail) -50 (or) 20 (ed)] TJ 12 TL (next) ' ET")
    b.raw(b"q 50 0 0 50 100 500 cm /Im Do Q q 1 0 0 1 0 0 cm /Fm Do Q")
    b.link((100, 695, 140, 712), "http://x")
    raw = b.finish()
    doc = Document(raw)
    ref, page = doc.pages()[0]
    n = max(doc.xref)
    image = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"\x7f")
    form = deflated(b"BT /F1 10 Tf 300 300 Td (inside form) Tj ET", Type=Name("XObject"), Subtype=Name("Form"), Resources=doc.get(page["Resources"]))
    return Document(update(doc, {n + 1: image, n + 2: form, ref.num: page | {"Resources": doc.get(page["Resources"]) | {"XObject": {"Im": Ref(n + 1), "Fm": Ref(n + 2)}}}}))


def test_redaction():
    doc = sample()
    before = {(g.text, round(g.matrix[4], 2), round(g.matrix[5], 2)) for g in shown(doc).glyphs}
    run = shown(doc)
    word = [g for g in run.glyphs if g.matrix[5] == 700][5:11]
    assert "".join(g.text for g in word) == "secret"
    area = (word[0].matrix[4] + 0.5, 702, word[-1].matrix[4] + 1, 705)
    raw, report = redact.apply(doc, 0, [area, (110, 510, 120, 520), (300, 295, 320, 310)])
    assert "".join(report.removed[:6]) == "secret" and report.images == 1 and report.operations == 2
    out = Document(raw)
    after = {(g.text, round(g.matrix[4], 2), round(g.matrix[5], 2)) for g in shown(out).glyphs}
    assert after < before and len(before - after) == report.glyphs  # what stays hasn't moved
    text = [x.text for x in lines(shown(out).glyphs)]
    assert "secret" not in " ".join(text) and any("keep" in t for t in text) and any("next" in t for t in text)
    assert not out.repaired and not shown(out).images and out.get(out.pages()[0][1].get("Annots")) == []
    assert b"secret" not in b"".join(out.decoded(v)[0] for _, _, v in out.objects() if isinstance(v, Stream))
    assert redact.apply(doc, 9, []) is None


def test_nothing_to_redact_changes_nothing():
    doc = sample()
    raw, report = redact.apply(doc, 0, [(0, 0, 1, 1)])
    flat = lambda d: [(g.text, *map(lambda v: round(v, 3), g.matrix)) for g in shown(d).glyphs]
    assert report.glyphs == 0 and flat(Document(raw)) == flat(doc)


def test_append():
    doc = sample()
    out = Document(redact.append(doc, 0, b"BT /F1 8 Tf 10 10 Td (stamp) Tj ET"))
    assert out.data.startswith(doc.data) and lines(shown(out).glyphs)[-1].text == "stamp"
