import struct

from tests.test_pdf import page_text
from tests.test_raster import PAIR, SQUARE, font

from docloom.sources import raster, truetype
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.writer import Builder


def program():
    base = raster.TrueType(font([b"", SQUARE, PAIR, SQUARE]))
    hhea = struct.pack(">I hh 26x H", 0x10000, 800, -200, 2)
    return truetype.assemble(base.tables | {"hhea": hhea, "hmtx": struct.pack(">HhHh", 250, 0, 600, 0)})


def test_font():
    f = truetype.Font(program())
    assert [f.width(g) for g in (0, 1, 2, 9)] == [250, 600, 600, 600] and f.components(2) == {1, 2} and f.components(99) == set()
    small = truetype.Font(f.subset([2]))
    assert small.outline(2) == f.outline(2) and small.outline(3) == [] and f.outline(3) and len(small.program) < len(f.program) and small.cmap == f.cmap


def test_embedded():
    f = truetype.Font(program())
    b = Builder()
    b.page(60, 20)
    assert truetype.embed(b, "E", "Mine", f.program) and not truetype.embed(b, "E", "Mine", f.program) and not truetype.embed(b, "X", "x", b"junk")
    assert truetype.embed_cid(b, "C", "Mine", f.program, "AB") and not truetype.embed_cid(b, "F1", "Mine", f.program, "A")
    b.text(0, 0, "AA", 10, "E")
    assert truetype.show(b, "C", f, 30, 0, "BxA", 10) == 1
    doc = Document(b.finish())
    assert not doc.repaired and page_text(doc, 0) == [("AA", 0), ("BA", 0)] or page_text(doc, 0) == [("AA BA", 0)]
    pixels, warnings = raster.render(doc, doc.pages()[0][1])
    dark = (pixels < 128).all(axis=2)
    assert not warnings and dark[16:20, 0:5].all() and not dark[:14].any() and dark[16:20, 6:11].all() and not dark[17, 5] and dark[18, 32]
