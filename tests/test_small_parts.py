"""Paths, meshes, sampling, faces, scopes, tree lookups, widths and tables without all their boxes."""

import math
import struct

import numpy as np
import pytest
from tests.test_truetype import program

from docloom.functions import maps
from docloom.operators import layout
from docloom.plans import QUERIES
from docloom.sources import mesh, paths, raster, synthesis
from docloom.sources.pdf import fonts
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref, Stream
from docloom.sources.pdf.writer import Builder, Edit


def test_paths():
    assert paths.parse("F1 M0,0 L10,0 10,10 h-5 v 5 z") == (False, [("m", 0, 0), ("l", 10, 0), ("l", 10, 10), ("l", 5, 10), ("l", 5, 15), ("h",)])
    assert paths.parse("M 1-2 l.5.5") == (True, [("m", 1, -2), ("l", 1.5, -1.5)])
    _, curve = paths.parse("M0,0 C0,1 1,2 2,2 S4,3 5,5")
    assert curve[2] == ("c", 3, 2, 4, 3, 5, 5)
    _, q = paths.parse("M0,0 Q3,3 6,0")
    assert q[1] == ("c", 2, 2, 4, 2, 6, 0)
    _, arc = paths.parse("M0,0 A5,5 0 0 1 10,0")
    points = [(x, y) for _, *v in arc[1:] for x, y in [v[4:6]]]
    assert all(math.isclose(math.hypot(x - 5, y), 5, abs_tol=1e-9) for x, y in points) and points[0] == pytest.approx((5, -5)) and points[-1] == (10, 0)
    _, grown = paths.parse("M0,0 A1,1 0 1 0 10,0")  # radii too small
    assert grown[-1][-2:] == (10, 0) and paths.parse("M0,0 A0,1 0 0 0 3,4")[1][1] == ("l", 3, 4)
    for bad in ("L1,1", "M1", "M0,0 X", "M0,0 L1,#", "M0,0 Z 1,1"):
        with pytest.raises(paths.PathError):
            paths.parse(bad)


def draw(shading, data, extra=b""):
    b = Builder()
    b._add("Shading", "S", Stream(shading | {"ColorSpace": Name("DeviceRGB")}, data))
    b.page(100, 100)
    b.raw(extra + b"/S sh")
    doc = Document(b.finish())
    return raster.render(doc, doc.pages()[0][1])


def vertex(x, y, rgb, flag=None):
    return (b"" if flag is None else bytes([flag])) + struct.pack(">HH", x, y) + bytes(rgb)


DECODE = [0, 100, 0, 100, 0, 1, 0, 1, 0, 1]
CORNER = 65535


def test_meshes():
    base = {"BitsPerCoordinate": 16, "BitsPerComponent": 8, "Decode": DECODE}
    red, blue = (255, 0, 0), (0, 0, 255)
    two = vertex(0, 0, red, 0) + vertex(CORNER, 0, red, 0) + vertex(0, CORNER, red, 0) + vertex(CORNER, CORNER, red, 1)
    pixels, warnings = draw(base | {"ShadingType": 4, "BitsPerFlag": 8}, two)
    assert not warnings and (pixels == red).all()
    half, _ = draw(base | {"ShadingType": 4, "BitsPerFlag": 8}, two[: len(two) * 3 // 4])
    assert abs(int((half[..., 1] == 0).sum()) - 5000) <= 100
    lattice = b"".join(vertex(x, y, red if x == 0 else blue) for y in (0, CORNER) for x in (0, CORNER))
    pixels, _ = draw(base | {"ShadingType": 5, "VerticesPerRow": 2}, lattice)
    assert np.allclose(pixels[50, :, 2], (np.arange(100) + 0.5) * 2.55, atol=1) and np.allclose(pixels[50, :, 0], 255 - pixels[50, :, 2], atol=1)
    third = CORNER // 3
    edge = [(0, 0), (0, third), (0, 2 * third), (0, CORNER), (third, CORNER), (2 * third, CORNER), (CORNER, CORNER), (CORNER, 2 * third), (CORNER, third), (CORNER, 0), (2 * third, 0), (third, 0)]
    inner = [(third, third), (third, 2 * third), (2 * third, 2 * third), (2 * third, third)]
    for kind, points in ((6, edge), (7, edge + inner)):
        data = b"\0" + b"".join(struct.pack(">HH", *p) for p in points) + bytes([*red, *red, *blue, *blue])
        pixels, _ = draw(base | {"ShadingType": kind, "BitsPerFlag": 8}, data)
        assert np.allclose(pixels[50, :, 2], (np.arange(100) + 0.5) * 2.55, atol=3), kind
    # A second patch goes on from a side of the first.
    small = mesh.Layout(6, 8, 16, 8, DECODE)
    more = data[: 1 + 48 + 12] if kind == 6 else b"\0" + b"".join(struct.pack(">HH", *p) for p in edge) + bytes([*red, *red, *blue, *blue])
    more += b"\2" + b"".join(struct.pack(">HH", *p) for p in edge[4:]) + bytes([*blue, *red])
    assert len(list(mesh.triangles(more, small))) == 2 * 2 * mesh.STEPS**2
    assert not list(mesh.triangles(b"", small)) and draw(base | {"ShadingType": 4, "Decode": [0, 1]}, b"x")[1]


def test_sampling():
    assert raster.sampling(100, 100, (50, 0, 0, 50, 0, 0)) == ("nearest", 1) and raster.sampling(100, 100, (10, 0, 0, 10, 0, 0)) == ("nearest", 3)
    assert raster.sampling(2, 2, (50, 0, 0, 50, 0, 0), True) == ("between", 0) and raster.sampling(2, 2, (50, 0, 0, 50, 0, 0)) == ("nearest", 0)
    chess = (np.indices((64, 64)).sum(0) % 2 * 255).astype(np.uint8)[..., None]
    canvas = raster.Canvas(8, 8)
    raster.draw_image(canvas, chess, (8, 0, 0, 8, 0, 0))
    assert np.allclose(canvas.colour, 128 / 255)  # no stripes
    canvas = raster.Canvas(40, 1)
    raster.draw_image(canvas, np.array([[[0], [200]]], np.uint8), (40, 0, 0, 1, 0, 0), smooth=True)
    line = canvas.colour[0, :, 0] * 255
    assert (np.diff(line) >= 0).all() and line[0] == 0 and np.isclose(line[-1], 200) and 90 < line[20] < 110


def test_faces():
    asked = []
    b = Builder(programs={"X": {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("ABCDEF+Mine-BoldItalic"), "Encoding": Name("WinAnsiEncoding")}})
    b.page(60, 20)
    b.text(0, 0, "A", 10, "X")
    doc = Document(b.finish())
    pixels, warnings = raster.render(doc, doc.pages()[0][1], faces=lambda r: asked.append(r) or program())
    assert not warnings and (pixels < 128).any() and asked == [{"family": "Mine", "bold": True, "italic": True, "serif": False, "fixed": False}]
    assert raster.render(doc, doc.pages()[0][1], faces=lambda r: None)[1] == {"font without a program": 1}


def test_widths():
    assert all(len(w.split()) == 95 for w in fonts._WIDTHS.values())
    assert [fonts.standard_face(n) for n in ("Helvetica", "ABCDEF+Arial-BoldMT", "TimesNewRomanPS-ItalicMT", "Courier-Oblique", "Mine")] == ["Helvetica", "Helvetica-Bold", "Times-Italic", "Courier", None]
    assert fonts.standard_width("Helvetica", "A", 0) == 667 and fonts.standard_width("Helvetica", "é", 0) == 556 and fonts.standard_width("Courier", "x", 0) == 600 and fonts.standard_width("Times-Bold", "中", 7) == 7


def test_edit_scopes():
    b = Builder(info={"Title": "a"})
    b.page()
    doc = Document(b.finish())
    edit = Edit(doc)
    info, page = doc.trailer["Info"].num, doc.pages()[0][0].num
    with edit.scope():
        edit.put(info, {"Title": b"b"})
        with pytest.raises(RuntimeError), edit.scope():
            edit.put(info, {"Title": b"c"})
            edit.add({"X": 1})
            raise RuntimeError
        assert edit.get(info) == {"Title": b"b"}
        ref = edit.add({"New": True})
    with pytest.raises(ValueError), edit.scope():
        edit.delete(page)
        edit.finish()
    new = Document(edit.finish())
    assert new.get(Ref(info)) == {"Title": b"b"} and new.get(ref) == {"New": True} and len(new.pages()) == 1 and new.data.startswith(doc.data)
    assert Edit(doc).finish() == doc.data


def test_lookup_prunes():
    b = Builder()
    b.page()
    doc = Document(b.finish())
    n = max(doc.xref)
    edit = Edit(doc)
    leaves = [edit.add({"Limits": [b"%02d" % i, b"%02d" % (i + 9)], "Names": [x for k in range(i, i + 10) for x in (b"%02d" % k, k)]}) for i in range(0, 100, 10)]
    root = edit.add({"Kids": leaves})
    doc = Document(edit.finish())
    assert doc.lookup(root, b"42") == (42, 1 + 5) and doc.lookup(root, b"4x") == (None, 11) and doc.lookup(root, b"zz")[0] is None and n
    assert [doc.lookup(root, k)[0] for k, _ in doc.name_tree(root)] == list(range(100))


def test_tables_without_all_their_boxes():
    cell, row = "table-cell", "table-row"
    assert layout.whole_table([(cell, 1), ("inline", 2), ("block", 3), (row, [(cell, 4), ("inline", 5)]), ("block", 6)]) == [[[1], [2, 3]], [[4], [5]], [[6]]]
    assert layout.whole_table([]) == [] and layout.whole_row([("inline", 1), ("inline", 2), (cell, 3)]) == [[1, 2], [3]]


def test_shapes_of_fixed_pages():
    assert synthesis._paint("#F00") == (1, 0, 0) and synthesis._paint("#80FF0000") == (1, 0, 0) and synthesis._paint("sc#1,0,0") == (1, 0, 0) and synthesis._paint("{x}") is None
    assert b"1 0 0 rg" in synthesis._shape({"data": "M0,0 L10,0 10,10 Z", "fill": "#F00", "stroke": None, "thickness": 0.75}, 100)
    assert synthesis._shape({"data": "M0,0", "fill": None, "stroke": None, "thickness": 1}, 100) is None


@pytest.mark.parametrize("name", ["ciphers", "font_programs", "stream_tiers", "xml_events", "xml_doctypes", "entry_names", "fixed_fonts", "image_round_trip", "face_requests", "path_syntax", "broken_blocks", "file_hashes", "raw_deflate"])
def test_small_tables_are_dealt_out(spark, name):
    """A small table is one file: what is done with its rows isn't left to the one task that reads it."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_fnv1a_is_no_larger_than_it_must(spark):
    """Known values, and a plan that doesn't hold its own parts hundreds of times."""
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(maps.fnv1a("t").alias("h"))
    assert [r.h for r in rows.collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 5000


@pytest.mark.parametrize("block", [(4096, 1 << 18), (3, 50)])
def test_triangles_are_painted_in_blocks(monkeypatch, block):
    """Triangles of a mesh go together, and what covers another is still the last one, as if each went by itself."""
    monkeypatch.setattr(mesh, "BLOCK_TRIANGLES", block[0])
    monkeypatch.setattr(mesh, "BLOCK_PIXELS", block[1])
    calls, repeat = [], np.repeat
    monkeypatch.setattr(mesh.np, "repeat", lambda *a, **k: calls.append(1) or repeat(*a, **k))
    rng = np.random.default_rng(3)
    shapes = [tuple((float(x), float(y), (float(c),)) for x, y, c in t) for t in rng.uniform(-5, 25, (60, 3, 3))]
    colour, covered = mesh.paint(iter(shapes), (1, 0, 0, 1, 0, 0), 20, 20, 1)
    want, seen = np.zeros((20, 20)), np.zeros((20, 20), bool)
    for (xa, ya, (ca,)), (xb, yb, (cb,)), (xc, yc, (cc,)) in shapes:
        y, x = np.mgrid[0:20, 0:20] + 0.5
        det = (yb - yc) * (xa - xc) + (xc - xb) * (ya - yc)
        a, b = ((yb - yc) * (x - xc) + (xc - xb) * (y - yc)) / det, ((yc - ya) * (x - xc) + (xa - xc) * (y - yc)) / det
        inside = (a >= -1e-9) & (b >= -1e-9) & (a + b <= 1 + 1e-9)
        want[inside] = (a * ca + b * cb + (1 - a - b) * cc)[inside]
        seen |= inside
    assert np.array_equal(seen, covered) and np.allclose(want, colour[..., 0])
    assert calls and (block[0] < 60 or len(calls) < 60)
