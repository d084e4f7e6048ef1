"""Redaction: glyphs under areas leave the content, what remains stays where it was, images under them go blank."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from docloom.sources.pdf.content import Glyph, Interpreter, Matrix, _matrix, then
from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref, Stream, references, write
from docloom.sources.pdf.writer import deflated, reachable, update
from docloom.sources.pdf.writer import rewrite as write_file

Area = tuple[float, float, float, float]


@dataclass
class Report:
    operations: int = 0
    glyphs: int = 0
    images: int = 0
    removed: list[str] = field(default_factory=list)


def _corners(m: Matrix, w: float, h0: float, h1: float) -> Area:
    points = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (0.0, w) for y in (h0, h1)]
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _hit(box: Area, areas: list[Area]) -> bool:
    return any(box[0] < a[2] and a[0] < box[2] and box[1] < a[3] and a[1] < box[3] for a in areas)


class _Rewriter(Interpreter):
    """Copies a content stream, show operators excepted: those are written again without what an area touches."""

    def __init__(self, doc: Document, areas: list[Area], report: Report):
        super().__init__(doc)
        self.areas, self.report = areas, report
        self.out = bytearray()
        self.blank_images: set[str] = set()
        self.forms: dict[str, Stream] = {}
        self.caught: list[Glyph] = []

    def on_glyph(self, glyph: Glyph) -> None:
        self.caught.append(glyph)

    def _emit(self, *operands: Any, op: str) -> None:
        self.out += b" ".join(write(x) for x in operands) + (b" " if operands else b"") + op.encode("latin-1") + b"\n"

    def _operator(self, op: str, a: list, resources: dict[str, Any], depth: int) -> None:
        if op in ("'", '"'):
            if op == '"':
                self._emit(a[-3], op="Tw")
                self._emit(a[-2], op="Tc")
            self._emit(op="T*")
        if op in ("Tj", "TJ", "'", '"'):
            self._show_again(op, a, resources, depth)
            return
        if op == "Do":
            self._object(a[-1], resources, depth)
            return
        self._emit(*a, op=op)
        super()._operator(op, a, resources, depth)

    def _show_again(self, op: str, a: list, resources: dict[str, Any], depth: int) -> None:
        font = self.state.font
        items = a[-1] if op == "TJ" else [a[-1]]
        if op in ("'", '"'):
            super()._operator(op, [*a[:-1], b""], resources, depth)
        new: list[Any] = []
        touched = False
        for x in items:
            if not isinstance(x, bytes) or font is None:
                if op == "TJ":
                    super()._operator("TJ", [[x]], resources, depth)
                new.append(x)
                continue
            codes, at = font.decode(x), 0
            for code, n, text, width in codes:
                self.caught = []
                self._show_one(code, n, text, width)
                g = self.caught[0]
                box = _corners(g.matrix, max(width, 0.001), -0.25, 1.0) if not g.vertical else _corners(g.matrix, 1.0, -1.0, 0.0)
                if _hit(box, self.areas):
                    touched = True
                    self.report.glyphs += 1
                    self.report.removed.append(g.text)
                    s = self.state
                    move = (-s.size if g.vertical else width * s.size) + s.char + (s.word if n == 1 and code == 32 else 0.0)
                    new.append(-1000 * move / s.size if s.size else 0)
                elif new and isinstance(new[-1], bytes) and at:
                    new[-1] += x[at : at + n]
                else:
                    new.append(x[at : at + n])
                at += n
        if touched:
            self.report.operations += 1
        self._emit([round(x, 4) if isinstance(x, float) else x for x in new], op="TJ")

    def _inline(self, p: Any) -> None:
        start = p.pos
        super()._inline(p)
        if _hit(_corners(self.state.ctm, 1.0, 0.0, 1.0), self.areas):
            self.report.images += 1
        else:
            self.out += b"BI " + p.data[start : p.pos].lstrip() + b"\n"

    def _object(self, name: Name, resources: dict[str, Any], depth: int) -> None:
        x = self._resource(resources, "XObject", name)
        if isinstance(x, Stream) and x.dict.get("Subtype") == "Image" and _hit(_corners(self.state.ctm, 1.0, 0.0, 1.0), self.areas):
            self.report.images += 1
            return
        if isinstance(x, Stream) and x.dict.get("Subtype") == "Form" and depth < 16:
            inner = _Rewriter(self.doc, self.areas, self.report)
            inner.state = self.state
            m = self.doc.get(x.dict.get("Matrix"))
            if isinstance(m, list) and len(m) >= 6:
                inner.state = replace(self.state, ctm=then(_matrix(m), self.state.ctm))
            before = self.report.glyphs + self.report.images
            inner.run(self.doc.decoded(x)[0], x.dict.get("Resources", resources), depth + 1)
            if self.report.glyphs + self.report.images > before:
                copy = deflated(bytes(inner.out))
                copy.dict = {k: v for k, v in x.dict.items() if k not in ("Filter", "DecodeParms", "Length")} | copy.dict
                new = Name(f"Redacted{len(self.forms)}")
                self.forms[new] = (copy, inner.forms)
                self._emit(new, op="Do")
                return
        self._emit(name, op="Do")


def rewrite(doc: Document, content: bytes, resources: Any, areas: list[Area]) -> tuple[bytes, Report, dict[str, Any]]:
    """(content, report, forms to add to the resources)."""
    report = Report()
    run = _Rewriter(doc, areas, report)
    run.run(content, resources)
    return bytes(run.out), report, run.forms


def apply(doc: Document, page: int, areas: list[Area]) -> tuple[bytes, Report] | None:
    """(file, report) with a page's areas cleared, written as a new file: an update would leave the old content in it."""
    leaves = doc.pages()
    if not 0 <= page < len(leaves) or leaves[page][0] is None:
        return None
    ref, d = leaves[page]
    body, report, forms = rewrite(doc, doc.contents(d), d.get("Resources"), areas)
    objects = reachable(doc, [r for k in ("Root", "Info") if isinstance(r := doc.trailer.get(k), Ref)])
    number = max([*doc.xref, *objects], default=0) + 1
    contents = number
    objects[contents] = deflated(body)
    resources = dict(doc.get(d.get("Resources")) or {})
    if forms:
        table = dict(doc.get(resources.get("XObject")) or {})
        for name, (stream, inner) in forms.items():
            number += 1
            if inner:
                own = dict(doc.get(stream.dict.get("Resources")) or {})
                nested = dict(doc.get(own.get("XObject")) or {})
                for k, (s, _) in inner.items():
                    number += 1
                    objects[number] = s
                    nested[k] = Ref(number)
                stream.dict["Resources"] = own | {"XObject": nested}
                number += 1
            objects[number] = stream
            table[name] = Ref(number)
        resources["XObject"] = table
    kept = {k: v for k, v in d.items() if k != "Annots"} | {"Contents": Ref(contents), "Resources": resources}
    notes = doc.get(d.get("Annots"))
    if isinstance(notes, list):
        kept["Annots"] = [n for n in notes if not ((box := doc.box(doc.get(n) or {}, "Rect")) and _hit(box, areas))]
    objects[ref.num] = kept
    trailer = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "ID")}
    # What only the old content needed isn't reached any more.
    live: dict[int, Any] = {}
    work = [r.num for r in trailer.values() if isinstance(r, Ref)]
    while work:
        n = work.pop()
        if n not in live and n in objects:
            live[n] = objects[n]
            work += [r.num for r in references(objects[n])]
    return write_file(live, trailer), report


def append(doc: Document, page: int, operators: bytes) -> bytes | None:
    """The file with operators after a page's content, in a graphics state of their own."""
    leaves = doc.pages()
    if not 0 <= page < len(leaves) or leaves[page][0] is None:
        return None
    ref, d = leaves[page]
    number = max(doc.xref, default=0) + 1
    old = doc.get(d.get("Contents"))
    parts = old if isinstance(old, list) else [d["Contents"]] if d.get("Contents") is not None else []
    changed = {number: Stream({}, b"q\n"), number + 1: deflated(b"\nQ q\n" + operators + b"\nQ\n"), ref.num: d | {"Contents": [Ref(number), *parts, Ref(number + 1)]}}
    return update(doc, changed)
