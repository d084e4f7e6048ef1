from docloom.sources import raster, xml
from docloom.sources.pdf import appearance, semantics
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref
from docloom.sources.pdf.writer import Builder, update


def blank():
    b = Builder()
    b.page(60, 40)
    return Document(b.finish())


def note(kind, **more):
    return {"Subtype": Name(kind), "Rect": [10, 10, 50, 30], "C": [1, 0, 0]} | more


def test_annotations_are_drawn():
    kinds = [note("Highlight"), note("Underline"), note("StrikeOut", QuadPoints=[10, 30, 50, 30, 10, 10, 50, 10]), note("Square", IC=[0, 1, 0]), note("Circle"), note("Line", L=[10, 20, 50, 20]), note("Ink", InkList=[[10, 10, 30, 30, 50, 10]]), note("FreeText", Contents=b"hi")]
    for n in kinds:
        doc = Document(appearance.add_annotation(blank(), 0, n))
        raw, count = appearance.flatten(doc, 0)
        flat = Document(raw)
        assert count == 1 and flat.get(flat.pages()[0][1]["Annots"]) == [], n
        pixels, _ = raster.render(flat, flat.pages()[0][1])
        inked = (pixels < 250).any(axis=2)
        assert inked.any() and not inked[:9].any() and not inked[31:].any() and not inked[:, :9].any() and not inked[:, 51:].any(), n
    assert appearance.synthesize(blank(), note("Stamp")) is None and appearance.synthesize(blank(), {"Subtype": Name("Square")}) is None


def test_flatten_keeps_links_and_states():
    doc = blank()
    n = max(doc.xref)
    ref, page = doc.pages()[0]
    on, off = appearance._form((0, 0, 5, 5), b"0 g 0 0 5 5 re f"), appearance._form((0, 0, 5, 5), b"")
    button = {"Subtype": Name("Widget"), "Rect": [0, 0, 10, 10], "AP": {"N": {"Yes": Ref(n + 2), "Off": Ref(n + 3)}}, "AS": Name("Yes")}
    doc = Document(update(doc, {n + 1: button, n + 2: on, n + 3: off, ref.num: page | {"Annots": [Ref(n + 1), {"Subtype": Name("Link"), "Rect": [0, 0, 9, 9]}, note("Square", F=2)]}}))
    raw, count = appearance.flatten(doc, 0)
    flat = Document(raw)
    assert count == 1 and len(flat.get(flat.pages()[0][1]["Annots"])) == 2 and flat.data.startswith(doc.data)
    pixels, _ = raster.render(flat, flat.pages()[0][1])
    assert (pixels[30:, :10] == 0).all() and (pixels[:30] == 255).all()
    assert appearance.flatten(doc, 7) is None


def form():
    doc = blank()
    n = max(doc.xref)
    fields = [{"FT": Name("Tx"), "T": b"a", "Rect": [5, 5, 55, 20], "MaxLen": 8, "DA": b"/Helv 9 Tf 0 g"}, {"FT": Name("Tx"), "T": b"ro", "Ff": 1, "V": b"x"}, {"FT": Name("Btn"), "T": b"c"}, {"FT": Name("Ch"), "T": b"ch", "Opt": [b"x", b"y"]}]
    refs = [Ref(n + 1 + i) for i in range(4)]
    return Document(update(doc, {r.num: f for r, f in zip(refs, fields, strict=True)} | {doc.trailer["Root"].num: doc.catalog() | {"AcroForm": {"Fields": refs}}}))


def test_fill():
    doc = form()
    raw, refused = appearance.fill(doc, {"a": "new é", "c": "Yes", "ch": "y"})
    out = Document(raw)
    assert refused is None and {f["name"]: f["value"] for f in semantics.fields(out)} == {"a": "new é", "ro": "x", "c": "Yes", "ch": "y"}
    look = out.decoded(appearance._normal(out, out.get(Ref(semantics.fields(out)[0]["num"])))[1])[0]
    assert "new é".encode("cp1252") in look and b"/Helv 9 Tf" in look
    for bad in ({"a": "much too long"}, {"a": "ok", "ro": "y"}, {"gone": "x"}, {"ch": "z"}):
        raw, refused = appearance.fill(doc, bad)
        assert raw is None and refused == list(bad)[-1]


def test_xml_events(spark):
    rows = list(xml.events(b'<?xml version="1.0"?><?p i?><!--c--><a xmlns="u" b="1" x:y="2" xmlns:x="v">t<b/>&amp;</a>'))
    assert [(r["kind"], r["depth"], r["namespace"], r["name"], r["text"]) for r in rows] == [("pi", 0, None, "p", "i"), ("comment", 0, None, None, "c"), ("start", 0, "u", "a", None), ("text", 1, None, None, "t"), ("start", 1, "u", "b", None), ("end", 1, "u", "b", None), ("text", 1, None, None, "&"), ("end", 0, "u", "a", None)]
    assert rows[2]["attrs"] == {"b": "1", "v|y": "2"}
    for bad in (b"<a>", b"", b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>', b"<!DOCTYPE html><a/>", b"<a>" * 400, b"<a b='1' b='2'/>"):
        assert list(xml.events(bad))[-1]["kind"] == "defect", bad
    assert [e["kind"] for e in xml.events(b"<!DOCTYPE html><a/>", True)] == ["start", "end"]
    assert list(xml.events('<a>é</a>'.encode("utf-16")))[1]["text"] == "é"
    files = spark.createDataFrame([("a", b"<x>1</x>"), ("b", b"<x"), ("z", None)], "doc_id string, content binary")
    assert {(r.doc_id, r.kind) for r in xml.read(files).collect()} == {("a", "start"), ("a", "text"), ("a", "end"), ("b", "defect"), ("z", "defect")}
    from pyspark.sql import functions as F

    kinds = spark.createDataFrame([(b"\xfe\xff\x00<",), (b"<\x00a\x00",), (b"<a/>",), (b"\xef\xbb\xbf<",)], "c binary").select(xml.encoding(F.col("c")).alias("e")).collect()
    assert [r.e for r in kinds] == ["UTF-16BE", "UTF-16LE", "UTF-8", "UTF-8"]
