"""Transparency groups: isolated or not, knocking out or not."""

import numpy as np
import pytest

from docloom.sources import raster
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref, Stream
from docloom.sources.pdf.writer import Builder, deflated


def draw(below, inner, outer=b"", **group):
    b = Builder()
    b.add_gstate("Half", fill=0.5)
    form = deflated(inner, Type=Name("XObject"), Subtype=Name("Form"))
    form.dict |= {"BBox": [0, 0, 100, 100], "Resources": {"ExtGState": {"Mul": {"BM": Name("Multiply")}, "Half": {"ca": 0.5}}}, "Group": {"S": Name("Transparency")} | group}
    assert b._add("XObject", "G", form)
    b.page(100, 100)
    b.raw(below + b" " + outer + b" /G Do")
    doc = Document(b.finish())
    return raster.render(doc, doc.pages()[0][1])[0]


BLUE = b"0 0 1 rg 0 0 100 100 re f"
YELLOW = b"/Mul gs 1 1 0 rg 0 0 50 100 re f"
TWO = b"/Half gs 1 0 0 rg 0 0 60 100 re f 0 1 0 rg 40 0 60 100 re f"


def test_isolated():
    assert tuple(draw(BLUE, YELLOW, I=True)[50, 25]) == (255, 255, 0)  # nothing below to multiply with
    assert tuple(draw(BLUE, YELLOW)[50, 25]) == (0, 0, 0) and tuple(draw(BLUE, YELLOW)[50, 75]) == (0, 0, 255)
    assert tuple(draw(BLUE, b"1 0 0 rg 0 0 100 100 re f", b"/Half gs")[50, 50]) == (128, 0, 128)


@pytest.mark.parametrize("isolated", [False, True])
def test_knockout(isolated):
    both = draw(b"", TWO, I=isolated)
    last = draw(b"", TWO, I=isolated, K=True)
    assert tuple(both[50, 50]) == (128, 191, 64) and tuple(last[50, 50]) == (128, 255, 128)
    assert tuple(both[50, 20]) == tuple(last[50, 20]) == (255, 128, 128) and tuple(last[50, 80]) == (128, 255, 128)
    over = draw(BLUE, TWO, I=isolated, K=True)
    assert tuple(over[50, 50]) == (0, 128, 128)


def shaded(function, **more):
    b = Builder()
    b._add("Shading", "S", {"ShadingType": 2, "ColorSpace": Name("DeviceGray"), "Coords": [0, 0, 100, 0], "Function": Ref(900)})
    b.page(100, 10)
    b.raw(b"/S sh")
    doc = Document(b.finish())
    shading = next(v for v in (doc.get(Ref(n)) for n in doc.xref) if isinstance(v, dict) and "ShadingType" in v)
    shading["Function"] = function
    return raster.render(doc, doc.pages()[0][1])[0][5, :, 0].astype(int)


def test_functions_in_gradients():
    ramp = (np.arange(100) + 0.5) / 100
    square = shaded(Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1]}, b"{ dup mul }"))
    assert np.abs(square - 255 * ramp**2).max() <= 1
    table = shaded(Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}, bytes([0, 255, 0])))
    assert np.abs(table - 255 * (1 - np.abs(2 * ramp - 1))).max() <= 1


def test_soft_masks_with_transfer():
    def masked(**more):
        b = Builder()
        form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 100, 100], "Group": {"S": Name("Transparency")}}, b"0.25 g 0 0 50 100 re f")
        assert b._add("XObject", "M", form)
        b.add_gstate("Soft")
        b.page(100, 100)
        b.raw(b"/Soft gs 0 0 100 100 re f")
        doc = Document(b.finish())
        resources = doc.get(doc.pages()[0][1]["Resources"])
        state = doc.get(doc.get(resources["ExtGState"])["Soft"])
        state["SMask"] = {"S": Name("Luminosity"), "G": doc.get(resources["XObject"])["M"]} | more
        pixels = raster.render(doc, doc.pages()[0][1])[0]
        return int(pixels[50, 25, 0]), int(pixels[50, 75, 0])

    assert masked() == (191, 255)
    assert masked(TR=Name("Identity")) == (191, 255)
    assert masked(TR={"FunctionType": 2, "Domain": [0, 1], "C0": [1], "C1": [0], "N": 1}) == (64, 0)
    assert masked(BC=[1.0]) == (191, 0)
