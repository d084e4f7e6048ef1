"""Linearized files: the order, the numbers that the first object tells, and the hint tables."""

import re

import pytest
from tests.test_pdf import page_text, sample

from docloom.sources.pdf import semantics
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.linear import is_linearized, linearize
from docloom.sources.pdf.objects import Parser, Ref


class Bits:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def align(self):
        self.at += -self.at % 8


@pytest.mark.parametrize("pages", [1, 2, 5])
@pytest.mark.parametrize("options", [{}, {"packed": True}])
def test_linearized(pages, options):
    source = Document(sample(max(pages, 1)).finish(**options)) if pages > 1 else None
    if source is None:
        from docloom.sources.pdf.writer import Builder

        b = Builder(info={"Title": "one"})
        b.page()
        b.text(20, 700, "Page 1 of 1")
        source = Document(b.finish(**options))
    raw = linearize(source)
    doc = Document(raw)
    assert is_linearized(doc) and not is_linearized(source) and not doc.repaired and not doc.warnings.found
    assert [page_text(doc, i) for i in range(pages)] == [page_text(source, i) for i in range(pages)]
    assert semantics.metadata(doc) == semantics.metadata(source) and semantics.outline(doc) == semantics.outline(source) and semantics.links(doc) == semantics.links(source)
    d = Parser(raw, raw.find(b"<<")).parse()
    at, size = d["H"]
    first = doc.pages()[0][0]
    assert d["L"] == len(raw) and d["N"] == pages and d["O"] == first.num and raw[d["T"] : d["T"] + 11] == b"\n0000000000"
    assert raw[at:].startswith(b"%d 0 obj" % max(n for n, e in doc.xref.items() if e.offset == at)) and raw[: at + size].endswith(b"endobj\n")
    # All of the first page stands before E: what is after it isn't needed to show it.
    shown = Document(raw[: d["E"]])
    assert doc.xref[doc.pages()[0][1]["Contents"].num].offset < d["E"]
    assert shown.opened
    hint = next(v for n, e, v in doc.objects() if e.offset == at)
    data, _ = doc.decoded(hint)
    bits = Bits(data)
    low, where, b_count, low_length, b_length = bits.take(32), bits.take(32), bits.take(16), bits.take(32), bits.take(16)
    for n in (32, 16, 32, 16):
        bits.take(n)
    b_refs, b_id = bits.take(16), bits.take(16)
    bits.take(32)
    counts = [low + bits.take(b_count) for _ in range(pages)]
    bits.align()
    lengths = [low_length + bits.take(b_length) for _ in range(pages)]
    bits.align()
    refs = [bits.take(b_refs) for _ in range(pages)]
    bits.align()
    assert where + size == doc.xref[first.num].offset and refs[0] == 0 and b_id >= 0
    # Pages follow one another: from each page object as many bytes as the table says, with as many objects.
    place = doc.xref[first.num].offset
    assert len(re.findall(rb"\d+ 0 obj\n", raw[place : place + lengths[0]])) == counts[0] and place + lengths[0] == d["E"]
    place = d["E"]
    for i in range(1, pages):
        assert doc.xref[doc.pages()[i][0].num].offset == place
        assert len(re.findall(rb"\d+ 0 obj\n", raw[place : place + lengths[i]])) == counts[i]
        place += lengths[i]
    shared = Bits(data[hint.dict["S"] :])
    begin, start, of_first, total = shared.take(32), shared.take(32), shared.take(32), shared.take(32)
    assert of_first == counts[0] and total >= of_first and (not begin or start + size == doc.xref[begin].offset)
    assert doc.get(Ref(d["O"]))["Type"] == "Page"


def test_nothing_to_linearize():
    assert linearize(Document(b"%PDF-1.4\n")) is None
