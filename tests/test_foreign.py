"""Files that no writer of this library made: written by hand, as other programs write them."""

import os
from pathlib import Path

import pytest

from docloom.sources import raster
from docloom.sources.pdf import semantics, tables
from docloom.sources.pdf.document import Document

BODY = """%PDF-1.3
%âãÏÓ
1 0 obj <</Type/Catalog/Pages 2 0 R/Outlines 10 0 R/PageLabels<</Nums[0<</S/R>>]>>>>
endobj
2 0 obj
<< /Type /Pages /Kids [ 3 0 R 4 0 R ] /Count 3 /MediaBox [ 0 0 200.0 100 ] /Resources << /Font << /F1 7 0 R >> >> >>
endobj
3 0 obj
<</Type/Page/Parent 2 0 R/Contents[5 0 R 6 0 R]/Rotate -90/Annots[<</Subtype/Link/Rect[1 2 3 4]/Border[0 0 0]/A<</S/URI/URI(http://x.test/\\(a\\))>>>>]>>
endobj
4 0 obj
<</Type/Pages/Parent 2 0 R/Kids[8 0 R 9 0 R]/Count 2/CropBox[10 10 90 90]>>
endobj
5 0 obj
<</Length 12 0 R>>
stream\r
BT /F1 12 Tf 1 0 0 1 20 50 Tm [(Hel) 20 (lo)] TJ
endstream
endobj
6 0 obj <</Length 43/Filter/ASCIIHexDecode>> stream
2820776F726C6429 20546A 0A4554>
endstream endobj
7 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding<</Differences[128/Euro/eacute]>>>>endobj
8 0 obj<</Type/Page/Parent 4 0 R/Contents 11 0 R>>endobj
9 0 obj<</Type/Page/Parent 4 0 R>>endobj
10 0 obj<</First 13 0 R/Last 13 0 R/Count 1>>endobj
11 0 obj<</Length 999>>stream
BT/F1 10 Tf 20 20 Td<8081>Tj T*(second)'ET
endstream endobj
12 0 obj 49 endobj
13 0 obj<</Title(\\376\\377\\000T\\000\\366)/Parent 10 0 R/Dest[8 0 R/XYZ null null 0]>>endobj
"""


def file(newline="\n", entries=True):
    raw = BODY.encode("latin-1")
    where = {}
    for n in range(1, 14):
        at = raw.find(b"\n%d 0 obj" % n) + 1
        where[n] = at
    table = b"xref\n0 14\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % where[n] for n in range(1, 14))
    end = b"trailer\n<</Size 14/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % len(raw)
    return raw + (table if entries else b"") + end


@pytest.mark.parametrize("entries", [True, False])
def test_written_by_hand(entries):
    doc = Document(file(entries=entries))
    assert doc.opened and doc.repaired != entries and doc.version() == "1.3" and not doc.encrypted
    pages = doc.pages()
    assert len(pages) == 3 and [doc.rotation(p) for _, p in pages] == [270, 0, 0]
    assert doc.boxes(pages[0][1])[1] == (0, 0, 200, 100) and doc.boxes(pages[2][1])[1] == (10, 10, 90, 90)
    lines = [(r["page_index"], r["text"]) for r in tables.TABLES["text_lines"][1](doc)]
    assert lines[0] == (0, "Hello world") and lines[1][0] == 1 and lines[1][1].startswith("€é")
    assert [(o["title"], o["page"]) for o in semantics.outline(doc)] == [("Tö", 1)]
    assert [(x["page"], x["target"]) for x in semantics.links(doc)] == [(0, "http://x.test/(a)")]
    assert semantics.label_ranges(doc)[0]["style"] == "R"
    for _, page in pages:
        raster.render(doc, page)


def test_files_of_a_folder():
    """Whatever PDF files a folder holds open, and their pages are read and drawn."""
    folder = os.environ.get("DOCLOOM_PDF_FOLDER")
    found = sorted(Path(folder).rglob("*.pdf")) if folder else []
    for path in found:
        doc = Document(path.read_bytes())
        assert doc.opened and doc.pages()
        for _, page in doc.pages():
            raster.render(doc, page)
