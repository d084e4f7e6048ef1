"""Archives made with zipfile, read by our own reader, whole and damaged."""

import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.sources import archive as ar
from docloom.sources import images


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_entries(method):
    files = {"a.txt": b"x" * 500, "dir/é.txt": b"", "b.bin": bytes(range(256))}
    raw = zipped(files, method)
    a = ar.Archive(raw)
    assert {e.name: a.read(e) for e in a.entries} == {n: (b, None) for n, b in files.items()} and not a.scanned
    assert [e.crc for e in a.entries] == [zlib.crc32(b) for b in files.values()]
    cut = ar.Archive(raw[: raw.find(b"PK\x01\x02")])
    assert cut.scanned and {e.name: cut.read(e)[0] for e in cut.entries} == files
    bad = bytearray(raw)
    bad[raw.find(b"a.txt") + 6] ^= 1
    assert ar.Archive(bytes(bad)).read(ar.Archive(bytes(bad)).entries[0])[0] is None


def test_natural_order():
    names = ["page10.png", "Page9.png", "page 1.png", "page09.png", "page2b", "page2a", "page2", "10", "9", "a", ""]
    have = [names[i] for i in ar.natural_order(names)]
    assert have.index("9") < have.index("10") < have.index("page2") < have.index("page2a") < have.index("page2b") < have.index("page09.png") < have.index("page10.png")
    assert sorted(have) == sorted(names)


PNG = images.png_encode(np.arange(48, dtype=np.uint8).reshape(4, 4, 3))


def test_comic(spark):
    raw = zipped({"p10.png": PNG, "p9.jpg": b"\xff\xd8\xff\xe0", "ComicInfo.xml": b"<x/>", ".png": b"no", "d/": b""})
    rows = list(ar.comic_pages(ar.Archive(raw)))
    assert [(r["page"], r["entry"], r["format"]) for r in rows] == [(0, "p9.jpg", "jpeg"), (1, "p10.png", "png")]


CONTAINER = b'<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = b"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" unique-identifier="id"><metadata><dc:title>A Book</dc:title><dc:identifier id="id">urn:uuid:12345678-1234-1234-1234-123456789abc</dc:identifier></metadata>
<manifest><item id="c1" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="pic.png" media-type="image/png" fallback="c1"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>
<spine toc="x"><itemref idref="c1"/><itemref idref="c2" linear="no" properties="rendition:layout-pre-paginated"/><itemref idref="gone"/></spine></package>"""
CHAPTER = b'<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title><meta name="viewport" content="width=600, height=800"/></head><body><h1>One &amp; more</h1><p>Some\n  <b>bold</b> text&nbsp;here</p><script>no</script><p>Two</p></body></html>'
NAV = b'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="a%20b.xhtml#s">First</a><ol><li><span>Part</span></li></ol></li></ol></nav></body></html>'
NCX = b'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Only</text></navLabel><content src="a%20b.xhtml"/></navPoint></navMap></ncx>'
ENCRYPTION = b'<encryption xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptedData><enc:EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><enc:CipherData><enc:CipherReference URI="OEBPS/f.otf"/></enc:CipherData></enc:EncryptedData></encryption>'


def book(**more):
    return zipped({"mimetype": b"application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/book.opf": OPF, "OEBPS/a b.xhtml": CHAPTER, "OEBPS/nav.xhtml": NAV, "OEBPS/toc.ncx": NCX} | more)


def test_book():
    b = ar.Book(ar.Archive(book()))
    chapters = list(b.chapters())
    assert [(c["path"], c["linear"], c["layout"]) for c in chapters] == [("OEBPS/a b.xhtml", True, "reflowable"), ("OEBPS/a b.xhtml", False, "pre-paginated"), (None, True, "reflowable")]
    assert chapters[0]["text"] == "One & more\nSome bold text here" + "\nTwo" or chapters[0]["text"] == "One & more\nSome bold text\xa0here\nTwo"
    assert chapters[0]["viewport"] == {"width": 600.0, "height": 800.0} and b.metadata["title"] == "A Book"
    assert [(n["depth"], n["title"], n["path"], n["fragment"]) for n in b.navigation()] == [(0, "First", "OEBPS/a b.xhtml", "s"), (1, "Part", None, None)]
    old = ar.Book(ar.Archive(book(**{"OEBPS/nav.xhtml": b"<broken"})))
    assert [n["title"] for n in old.navigation()] == ["Only"] and old.defects


@pytest.mark.parametrize("how", ["idpf", "adobe"])
def test_obfuscation(how):
    body = bytes(random.Random(1).randrange(256) for _ in range(3000))
    ident = "urn:uuid:12345678-1234-1234-1234-123456789abc"
    hidden = ar.deobfuscate(how, ident, body)
    assert hidden != body and ar.deobfuscate(how, ident, hidden) == body
    assert ar.deobfuscate("adobe", "short", body) is None
    if how == "idpf":
        b = ar.Book(ar.Archive(book(**{"META-INF/encryption.xml": ENCRYPTION, "OEBPS/f.otf": hidden})))
        assert b.font("OEBPS/f.otf") == body
    assert ar.odttf("x/12345678-1234-1234-1234-123456789ABC.odttf", ar.odttf("12345678-1234-1234-1234-123456789ABC.odttf", body)) == body


def test_xml_bombs():
    for bomb in (b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>', b'<!DOCTYPE a SYSTEM "x" [<!ENTITY % p SYSTEM "y">%p;]><a/>', b"<a", "<!DOCTYPE a []><a/>".encode("utf-16")):
        with pytest.raises(ar.XmlRefused):
            ar.parse_xml(bomb)
    assert ar.parse_xml(b"<!DOCTYPE html><a>&eacute;</a>").text == "é"


def test_paths():
    assert ar.resolve("OEBPS/x/a.html", "../b%20c.html#f") == "OEBPS/b c.html" and ar.resolve("a.html", "../../b") is None
    assert ar.resolve("a/b", "http://x") is None and ar.resolve("a/b", "%FF") is None and ar.resolve("a/b", "/c") == "c"


def fixed():
    rel = lambda kind, target: f'<Relationships><Relationship Id="R" Type="http://schemas.microsoft.com/xps/2005/06/{kind}" Target="{target}"/></Relationships>'.encode()
    return zipped({
        "[Content_Types].xml": b'<Types><Default Extension="fpage" ContentType="page"/><Override PartName="/d/special.fpage" ContentType="other"/></Types>',
        "_rels/.rels": rel("fixedrepresentation", "/seq.fdseq"),
        "seq.fdseq": b'<FixedDocumentSequence><DocumentReference Source="d/doc.fdoc"/></FixedDocumentSequence>',
        "d/doc.fdoc": b'<FixedDocument><PageContent Source="1.fpage"/><PageContent Source="gone.fpage"/></FixedDocument>',
        "d/1.fpage": b'<FixedPage Width="816" Height="1056"><Glyphs OriginX="96" OriginY="96" FontRenderingEmSize="16" UnicodeString="{}{hello}"/></FixedPage>',
    })


def test_fixed():
    p = ar.Package(ar.Archive(fixed()))
    pages = list(p.pages())
    assert p.media_type("/d/1.fpage") == "page" and p.media_type("/D/Special.fpage") == "other"
    assert [(x["page"], x["width"], x["height"]) for x in pages] == [(0, 612.0, 792.0), (1, None, None)]
    assert pages[0]["runs"] == [{"x": 72.0, "y": 72.0, "size": 12.0, "text": "{hello}"}]
    assert ar.indices("(2:1)5,50;;7,,1") == [{"codes": 2, "glyphs": 1, "glyph": 5, "advance": 50.0, "u": None, "v": None}, {"codes": 1, "glyphs": 1, "glyph": None, "advance": None, "u": None, "v": None}, {"codes": 1, "glyphs": 1, "glyph": 7, "advance": None, "u": 1.0, "v": None}]


def test_tables(spark):
    files = [("book", book()), ("xps", fixed()), ("comic", zipped({"1.png": PNG})), ("no", b"PK nothing"), ("none", None)]
    df = spark.createDataFrame(files, "doc_id string, content binary")
    rows = {t: ar.read(df, t).collect() for t in ar.TABLES}
    assert {r.doc_id: r.kind for r in rows["archives"]} == {"book": "epub", "xps": "xps", "comic": "comic"}
    assert len(rows["entries"]) == 12 and all(r.defect is None for r in rows["entries"])
    assert len(rows["chapters"]) == 3 and len(rows["navigation"]) == 2 and len(rows["fixed_pages"]) == 2


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1 << 30))
def test_hostile_archives(seed):
    r, raw = random.Random(seed), bytearray(r_book)
    for _ in range(r.randrange(1, 10)):
        raw[r.randrange(len(raw))] = r.randrange(256)
    a = ar.Archive(bytes(raw))
    for e in a.entries:
        a.read(e)


r_book = book()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 1 << 20))
def test_png_round_trip(w, h, channels, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (h, w, channels), dtype=np.uint8)
    assert (images.png_decode(images.png_encode(pixels)) == pixels).all()
    if channels in (1, 3):
        assert (images.read_pnm(images.write_pnm(pixels)) == pixels).all()
    other = pixels.copy()
    other[0, 0, 0] ^= 0xFF
    found = images.compare(pixels, other)
    assert found["worst"] == abs(int(pixels[0, 0, 0]) - int(other[0, 0, 0])) and found["x"] == found["y"] == 0


def test_png_kinds():
    import struct

    def png(w, h, depth, colour, rows, extra=b"", interlace=0):
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(rows))

    palette = lambda b: struct.pack(">I", len(b)) + b"PLTE" + b + struct.pack(">I", zlib.crc32(b"PLTE" + b))
    assert images.png_decode(png(3, 1, 1, 0, b"\0\xa0"))[0, :, 0].tolist() == [255, 0, 255]
    assert images.png_decode(png(2, 1, 4, 3, b"\0\x10", palette(bytes([1, 2, 3, 4, 5, 6]))))[0].tolist() == [[4, 5, 6], [1, 2, 3]]
    assert images.png_decode(png(1, 1, 16, 0, b"\0\x12\x34"))[0, 0].tolist() == [0x12]
    assert images.png_decode(png(2, 2, 8, 0, b"\0\x01\0\x02\0\x03\x04", interlace=1))[:, :, 0].tolist() == [[1, 2], [3, 4]]
    for bad in (b"no", png(1, 1, 3, 0, b""), png(1, 1, 8, 3, b""), png(0, 1, 8, 0, b"")):
        with pytest.raises(images.ImageError):
            images.png_decode(bad)
    assert images.jpeg_shape(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x03rest") == (32, 16, 3) and images.jpeg_shape(b"x") is None


def test_no_entry_is_left_out(monkeypatch):
    """Archives of more entries than two bytes count are whole; what is beyond the limit is refused aloud."""
    raw = zipped({f"{i}.txt": b"" for i in range(65_600)})
    assert len(ar.Archive(raw).entries) == 65_600 and len(ar.Archive(raw[: raw.find(b"PK\x01\x02")]).entries) == 65_600
    monkeypatch.setattr(ar, "MAX_ENTRIES", 100)
    with pytest.raises(ValueError, match="entries"):
        ar.Archive(raw)
