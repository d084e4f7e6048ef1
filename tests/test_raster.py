import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.sources import images, raster
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref, Stream
from docloom.sources.pdf.writer import Builder, deflated, update


def test_fill():
    box = raster.flatten([("re", 1, 1, 2, 2)])
    mask = raster.fill_mask([p for p, _ in box], 4, 4)
    assert mask.tolist() == [[0, 0, 0, 0], [0, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 0]]
    assert raster.fill_mask([[(0.25, 0), (0.75, 0), (0.75, 1), (0.25, 1)]], 1, 1)[0, 0] == pytest.approx(0.5)
    ring = [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (4, 2), (4, 4), (2, 4)]]
    assert raster.fill_mask(ring, 6, 6)[3, 3] == 1 and raster.fill_mask(ring, 6, 6, True)[3, 3] == 0
    assert raster.fill_mask([ring[0], ring[1][::-1]], 6, 6)[3, 3] == 0
    circle = raster.flatten([("m", 10, 5), ("c", 10, 7.761, 7.761, 10, 5, 10), ("c", 2.239, 10, 0, 7.761, 0, 5), ("c", 0, 2.239, 2.239, 0, 5, 0), ("c", 7.761, 0, 10, 2.239, 10, 5), ("h",)])
    assert raster.fill_mask([p for p, _ in circle], 10, 10).sum() == pytest.approx(math.pi * 25, rel=0.02)
    assert raster.fill_mask([[(math.inf, 0), (1, 1), (0, 2)]], 2, 2).shape == (2, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 12), st.floats(-5, 12)), min_size=3, max_size=8))
def test_fill_is_the_area_within(points):
    mask = raster.fill_mask([points], 8, 8)
    assert ((mask >= 0) & (mask <= 1)).all()
    even = raster.fill_mask([points], 8, 8, True)
    assert (even <= mask + 1e-9).all()


def test_stroke_and_dashes():
    area = lambda shapes: raster.fill_mask(shapes, 20, 20).sum()
    line = [(4.0, 10.0), (14.0, 10.0)]
    assert area(raster.stroke(line, 2)) == pytest.approx(20) and area(raster.stroke(line, 2, cap=2)) == pytest.approx(24) and area(raster.stroke(line, 2, cap=1)) == pytest.approx(20 + math.pi, rel=0.05)
    corner = [(4.0, 4.0), (14.0, 4.0), (14.0, 14.0)]
    assert area(raster.stroke(corner, 2)) == pytest.approx(40, abs=0.2) and area(raster.stroke(corner, 2, join=2)) == pytest.approx(39.5, abs=0.2) and area(raster.stroke(corner, 2, miter=1.0)) == pytest.approx(39.5, abs=0.2)
    square = [(4.0, 4.0), (14.0, 4.0), (14.0, 14.0), (4.0, 14.0)]
    assert area(raster.stroke(square, 2, closed=True)) == pytest.approx(80, abs=0.5)
    assert raster.stroke([(1.0, 1.0)], 2) == [] and len(raster.stroke([(1.0, 1.0)], 2, cap=1)) == 1
    lengths = [sum(math.dist(a, b) for a, b in zip(d, d[1:], strict=False)) for d in raster.dashes(line, [3, 1], 1)]
    assert lengths == pytest.approx([2, 3, 3]) and raster.dashes(line, []) == [line] and raster.dashes(line, [0, 0]) == [line]


def test_blend():
    r = np.random.default_rng(1)
    a, b = r.random(50), r.random(50)
    for mode in ("Normal", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion"):
        out = raster.blend(mode, a, b)
        assert ((out >= -1e-9) & (out <= 1 + 1e-9)).all()
    c = raster.Canvas(1, 1)
    c.clear((1, 1, 1))
    c.paint(np.ones((1, 1)), (1, 0, 0), 0.5)
    c.paint(np.ones((1, 1)), (0.5, 0.5, 0.5), 1.0, "Multiply")
    assert c.pixels()[0, 0].tolist() == [128, 64, 64]
    group = raster.Canvas(1, 1)
    group.paint(np.ones((1, 1)), (0, 0, 1), 0.5)
    c.clear((1, 1, 1))
    c.compose(group)
    assert c.pixels()[0, 0].tolist() == [128, 128, 255] and group.luminosity()[0, 0] == pytest.approx(0.055) and group.pixels(True)[0, 0, 3] == 128


def test_gradients():
    x, y = np.array([[0.0, 5.0, 10.0, 20.0]]), np.zeros((1, 4))
    t, ok = raster.gradient(2, (0, 0, 10, 0), x, y)
    assert t.tolist() == [[0, 0.5, 1, 1]] and ok.tolist() == [[True, True, True, False]]
    t, ok = raster.gradient(3, (0, 0, 0, 0, 0, 10), x, y, (False, True))
    assert t.tolist() == [[0, 0.5, 1, 1]] and ok.all()


def page(ops, **options):
    b = Builder()
    b.page(20, 10, options.pop("rotate", 0))
    for k, v in options.items():
        getattr(b, k)(*v)
    b.raw(ops)
    doc = Document(b.finish())
    return raster.render(doc, doc.pages()[0][1])


def test_pages():
    pixels, warnings = page(b"1 0 0 rg 0 0 10 10 re f 0 0 1 RG 2 w 0 5 m 20 5 l S")
    assert pixels.shape == (10, 20, 3) and pixels[0, 0].tolist() == [255, 0, 0] and pixels[0, 19].tolist() == [255, 255, 255] and pixels[5, 15].tolist() == [0, 0, 255] and not warnings
    pixels, _ = page(b"0 g 0 0 5 5 re f", rotate=90)
    assert pixels.shape == (20, 10, 3) and pixels[0, 0].tolist() == [0, 0, 0] and pixels[-1, -1].tolist() == [255, 255, 255]
    pixels, _ = page(b"q 0 0 5 10 re W n 0 g 0 0 20 10 re f Q 0 1 0 rg 15 0 5 10 re f")
    assert pixels[5, 2].tolist() == [0, 0, 0] and pixels[5, 7].tolist() == [255, 255, 255] and pixels[5, 17].tolist() == [0, 255, 0]
    pixels, _ = page(b"/G gs 0 g 0 0 20 10 re f", add_gstate=("G", 0.5))
    assert pixels[0, 0].tolist() == [128, 128, 128]
    pixels, _ = page(b"/S sh", add_shading=("S", [0, 0, 20, 0], [(0, (0, 0, 0)), (1, (1, 1, 1))]))
    assert pixels[0, 0, 0] < 12 and pixels[0, 19, 0] > 240 and (np.diff(pixels[0, :, 0].astype(int)) > 0).all()
    body = images.png_encode(np.array([[[255, 0, 0], [0, 255, 0]]], np.uint8))
    pixels, _ = page(b"q 20 0 0 10 0 0 cm /I Do Q", add_image=("I", body))
    assert pixels[5, 3].tolist() == [255, 0, 0] and pixels[5, 15].tolist() == [0, 255, 0]
    pixels, warnings = page(b"BT /F1 8 Tf 1 1 Td (ab) Tj ET")
    assert (pixels < 255).any() and warnings == {"font without a program": 2}


def test_groups_and_soft_masks():
    b = Builder()
    b.page(20, 10)
    overlap = b"1 0 0 rg 0 0 10 10 re f 0 0 1 rg 5 0 10 10 re f"
    assert b.add_form("Plain", (0, 0, 20, 10), overlap) and b.add_form("Group", (0, 0, 20, 10), overlap, True) and b.add_gstate("Half", 0.5)
    b.raw(b"/Half gs /Group Do")
    doc = Document(b.finish())
    pixels, _ = raster.render(doc, doc.pages()[0][1])
    assert pixels[5, 7].tolist() == [128, 128, 255] and pixels[5, 2].tolist() == [255, 128, 128]  # the group is composed as one
    b.pages[0]["ops"] = bytearray(b"/Half gs /Plain Do")
    doc = Document(b.finish())
    assert raster.render(doc, doc.pages()[0][1])[0][5, 7].tolist() == [128, 64, 191]
    ref, page = doc.pages()[0]
    n = max(doc.xref)
    form = deflated(b"1 g 0 0 10 10 re f", Type=Name("XObject"), Subtype=Name("Form"))
    form.dict |= {"BBox": [0, 0, 20, 10], "Group": {"S": Name("Transparency")}}
    for kind in ("Luminosity", "Alpha"):
        masked = Document(update(doc, {n + 1: form, n + 2: Stream({}, b"/M gs 0 g 0 0 20 10 re f"), ref.num: page | {"Contents": Ref(n + 2), "Resources": {"ExtGState": {"M": {"SMask": {"S": Name(kind), "G": Ref(n + 1)}}}}}}))
        pixels, _ = raster.render(masked, masked.pages()[0][1])
        assert pixels[5, 5].tolist() == [0, 0, 0] and pixels[5, 15].tolist() == [255, 255, 255]


def font(glyphs):
    """A font of simple glyphs given by their bytes."""
    loca, glyf = [0], b""
    for g in glyphs:
        glyf += g + b"\0" * (len(g) % 2)
        loca.append(len(glyf))
    head = struct.pack(">18xH30xh2x", 1000, 1)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHH", 66, 0xFFFF, 0) + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">HH", (1 - 65) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    tables = {b"cmap": cmap, b"glyf": glyf, b"head": head, b"loca": struct.pack(f">{len(loca)}I", *loca)}
    out, body = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b""
    for tag, t in tables.items():
        out += tag + struct.pack(">III", 0, 12 + 16 * len(tables) + len(body), len(t))
        body += t
    return out + body


SQUARE = struct.pack(">hhhhh", 1, 0, 0, 500, 500) + struct.pack(">HH", 3, 0) + bytes([1] * 4) + struct.pack(">hhhh", 0, 500, 0, -500) + struct.pack(">hhhh", 0, 0, 500, 0)
PAIR = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHbb", 0x22, 1, 0, 0) + struct.pack(">HHbbh", 0xA, 1, 100, 100, 8192)


def test_truetype():
    f = raster.TrueType(font([b"", SQUARE, PAIR]))
    assert f.units == 1000 and f.cmap == {65: 1, 66: 2} and f.outline(0) == [] and f.outline(9) == []
    assert f.outline(1) == [("m", 0, 0), ("l", 500, 0), ("l", 500, 500), ("l", 0, 500), ("l", 0, 0), ("h",)]
    assert f.outline(2)[6:8] == [("m", 100, 100), ("l", 350, 100)]
    curve = raster._quadratic([(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0)])
    assert curve[0] == ("m", 0, 1) and [c[-2:] for c in curve[1:-1]] == [(1, 0), (2, 1), (1, 2), (0, 1)]


def test_render_pages(spark):
    b = Builder()
    b.page(30, 20)
    b.raw(b"0 g 0 0 30 10 re f")
    files = spark.createDataFrame([("a", b.finish()), ("n", b"x"), ("z", None)], "doc_id string, content binary")
    rows = raster.render_pages(files, 144.0).collect()
    assert [(r.doc_id, r.width, r.height) for r in rows] == [("a", 60, 40)]
    pixels = images.png_decode(bytes(rows[0].png))
    assert pixels[0, 0].tolist() == [255] * 3 and pixels[39, 0].tolist() == [0] * 3


@pytest.mark.parametrize("held", [1, 40, 1 << 18])
@pytest.mark.parametrize("even_odd", [False, True])
def test_scan_lines_together_cover_what_each_does(monkeypatch, held, even_odd):
    """Crossings taken many lines at once, in blocks of any size, against one line at a time."""
    monkeypatch.setattr(raster, "CROSSINGS", held)
    r = random.Random(8)
    for _ in range(40):
        width, height = r.randrange(1, 40), r.randrange(1, 40)
        shapes = [[(r.uniform(-9, 49), r.choice((r.uniform(-9, 49), r.randrange(-9, 49)))) for _ in range(r.randrange(3, 7))] for _ in range(r.randrange(1, 4))]
        want = np.zeros((height, width))
        for s in range(height * raster.ROWS):
            y, cut = (s + 0.5) / raster.ROWS, []
            for p in shapes:
                for (x0, y0), (x1, y1) in zip(p, [*p[1:], p[0]], strict=True):
                    if min(y0, y1) <= y < max(y0, y1):
                        cut.append((x0 + (y - y0) * (x1 - x0) / (y1 - y0), 1 if y0 < y1 else -1))
            cut.sort()
            for k in range(len(cut) - 1):
                if (k + 1) % 2 if even_odd else sum(w for _, w in cut[: k + 1]):
                    a, b = (min(max(cut[k + d][0], 0), width) for d in (0, 1))
                    want[s // raster.ROWS] += np.clip(np.minimum(b, np.arange(1, width + 1)) - np.maximum(a, np.arange(width)), 0, None)
        assert np.allclose(raster.fill_mask(shapes, width, height, even_odd), np.minimum(want / raster.ROWS, 1), atol=1e-9)


def test_paint_changes_what_the_mask_covers():
    """Only rows and columns of the mask are worked on, and what is there is as if all were."""
    rng = np.random.default_rng(9)
    for mode in ("Normal", "Multiply", "Screen"):
        c = raster.Canvas(12, 9)
        c.colour[:], c.alpha[:], c.own[:] = rng.random((9, 12, 3)), rng.random((9, 12)), rng.random((9, 12))
        mask = np.zeros((9, 12))
        mask[2:5, 3:7] = rng.random((3, 4))
        assert raster._where(mask) == (slice(2, 5), slice(3, 7))
        colour, alpha, own, a = c.colour.copy(), c.alpha.copy(), c.own.copy(), mask * 0.7
        union = a + alpha - a * alpha
        share = (a / union)[..., None]
        source = np.broadcast_to(np.array([0.2, 0.4, 0.9]), colour.shape)
        mixed = (1 - alpha[..., None]) * source + alpha[..., None] * raster.blend(mode, colour, source)
        c.paint(mask, (0.2, 0.4, 0.9), 0.7, mode)
        assert (c.alpha == union).all() and (c.colour == (1 - share) * colour + share * mixed).all() and (c.own == own + a - own * a).all()
        c.paint(np.zeros((9, 12)), (0, 0, 0))
        assert (c.alpha == union).all()
