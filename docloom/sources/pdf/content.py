"""The content interpreter: a page's operators folded into glyphs, images, paths and marks."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from docloom.sources.pdf.document import Document
from docloom.sources.pdf.fonts import Font
from docloom.sources.pdf.objects import Keyword, Name, Parser, Stream

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MAX_FORMS = 16
MAX_OPERATORS = 5_000_000


def then(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


@dataclass(frozen=True)
class State:
    ctm: Matrix = IDENTITY
    font: Font | None = None
    font_name: str = ""
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    fill: tuple = ("g", (0.0,))
    stroke: tuple = ("g", (0.0,))
    width: float = 1.0


@dataclass(slots=True)
class Glyph:
    code: int
    text: str
    matrix: Matrix  # of the glyph: x, y are its last two
    advance: float
    size: float
    vertical: bool
    font: str
    artifact: bool
    mode: int


class Interpreter:
    """Runs a page and gathers what it shows. Subclasses may take the events instead, by overriding the on_ methods."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.glyphs: list[Glyph] = []
        self.images: list[tuple[str, Matrix]] = []
        self.paths: list[tuple[str, tuple, list]] = []
        self.state, self.stack = State(), []
        self.tm = self.tlm = IDENTITY
        self.scopes: list[bool] = []
        self.path: list[tuple] = []
        self.budget = MAX_OPERATORS

    # Events.

    def on_glyph(self, glyph: Glyph) -> None:
        self.glyphs.append(glyph)

    def on_image(self, name: str, matrix: Matrix) -> None:
        self.images.append((name, matrix))

    def on_path(self, operator: str, state: State, path: list) -> None:
        self.paths.append((operator, state.fill if operator[0] in "fFBb" else state.stroke, path))

    # Running.

    def run(self, content: bytes, resources: Any, depth: int = 0) -> None:
        resources = self.doc.get(resources)
        resources = resources if isinstance(resources, dict) else {}
        p, operands = Parser(content, 0, self.doc.warnings), []
        while self.budget > 0:
            item = p.parse(refs=False)
            if not isinstance(item, Keyword):
                operands.append(item)
                del operands[:-64]
                continue
            if item == "":
                return
            self.budget -= 1
            if not self.budget:
                self.doc.warnings.add("operators after the limit")
            if item == "BI":
                self._inline(p)
            else:
                try:
                    self._operator(str(item), operands, resources, depth)
                except (TypeError, ValueError, IndexError, OverflowError):
                    self.doc.warnings.add("operands")
            operands = []

    def _inline(self, p: Parser) -> None:
        while not isinstance(key := p.parse(refs=False), Keyword):
            p.parse(refs=False)
        if key != "ID":
            return
        at = p.pos + 1
        while (end := p.data.find(b"EI", at)) >= 0:
            if p.data[end - 1 : end] in (b"\n", b" ", b"\r", b"\t") and p.data[end + 2 : end + 3] in (b"", b"\n", b" ", b"\r", b"\t"):
                break
            at = end + 2
        p.pos = len(p.data) if end < 0 else end + 2
        self.on_image("inline", self.state.ctm)

    def _resource(self, resources: dict[str, Any], kind: str, name: Any) -> Any:
        table = self.doc.get(resources.get(kind))
        return self.doc.get(table.get(name)) if isinstance(table, dict) else None

    def _font(self, resources: dict[str, Any], name: str) -> Font | None:
        d = self._resource(resources, "Font", name)
        if not isinstance(d, dict):
            self.doc.warnings.add("font missing")
            return None
        made = self.doc.fonts
        if id(d) not in made:
            made[id(d)] = d, Font(self.doc, d)
        return made[id(d)][1]

    def _operator(self, op: str, a: list, resources: dict[str, Any], depth: int) -> None:
        s = self.state
        match op:
            case "q":
                if len(self.stack) < 512:
                    self.stack.append(s)
            case "Q":
                if self.stack:
                    self.state = self.stack.pop()
            case "cm":
                self.state = replace(s, ctm=then(_matrix(a), s.ctm))
            case "BT" | "ET":
                self.tm = self.tlm = IDENTITY
            case "Tf":
                self.state = replace(s, font=self._font(resources, a[-2]), font_name=str(a[-2]), size=float(a[-1]))
            case "Tc":
                self.state = replace(s, char=float(a[-1]))
            case "Tw":
                self.state = replace(s, word=float(a[-1]))
            case "Tz":
                self.state = replace(s, stretch=a[-1] / 100)
            case "TL":
                self.state = replace(s, leading=float(a[-1]))
            case "Ts":
                self.state = replace(s, rise=float(a[-1]))
            case "Tr":
                self.state = replace(s, mode=int(a[-1]))
            case "Td" | "TD":
                if op == "TD":
                    self.state = replace(s, leading=-float(a[-1]))
                self._move(float(a[-2]), float(a[-1]))
            case "Tm":
                self.tm = self.tlm = _matrix(a)
            case "T*":
                self._move(0.0, -s.leading)
            case "Tj":
                self._show(a[-1])
            case "'":
                self._move(0.0, -s.leading)
                self._show(a[-1])
            case '"':
                self.state = replace(s, word=float(a[-3]), char=float(a[-2]))
                self._move(0.0, -s.leading)
                self._show(a[-1])
            case "TJ":
                for x in a[-1]:
                    if isinstance(x, bytes):
                        self._show(x)
                    elif isinstance(x, (int, float)):
                        shift = -x / 1000 * s.size
                        self.tm = then((1, 0, 0, 1, 0, shift) if s.font and s.font.vertical else (1, 0, 0, 1, shift * s.stretch, 0), self.tm)
            case "m" | "l" | "c" | "v" | "y" | "re":
                self.path.append((op, *map(float, a)))
            case "h":
                self.path.append(("h",))
            case "S" | "s" | "f" | "F" | "f*" | "B" | "B*" | "b" | "b*":
                self.on_path(op, s, self.path)
                self.path = []
            case "n":
                self.path = []
            case "w":
                self.state = replace(s, width=float(a[-1]))
            case "g" | "rg" | "k" | "sc" | "scn":
                self.state = replace(s, fill=(op, tuple(a)))
            case "G" | "RG" | "K" | "SC" | "SCN":
                self.state = replace(s, stroke=(op, tuple(a)))
            case "Do":
                self._do(a[-1], resources, depth)
            case "BMC" | "BDC":
                self.scopes.append(bool(self.scopes and self.scopes[-1]) or str(a[0]) == "Artifact")
            case "EMC":
                if self.scopes:
                    self.scopes.pop()

    def _do(self, name: Name, resources: dict[str, Any], depth: int) -> None:
        x = self._resource(resources, "XObject", name)
        if not isinstance(x, Stream):
            self.doc.warnings.add("XObject missing")
        elif x.dict.get("Subtype") == "Image":
            self.on_image(str(name), self.state.ctm)
        elif x.dict.get("Subtype") == "Form" and depth < MAX_FORMS:
            self._do_form(x, resources, depth)

    def _do_form(self, x: Stream, resources: dict[str, Any], depth: int) -> None:
        saved, stack, text = self.state, self.stack, (self.tm, self.tlm)
        m = self.doc.get(x.dict.get("Matrix"))
        self.state, self.stack = replace(saved, ctm=then(_matrix(m) if isinstance(m, list) and len(m) >= 6 else IDENTITY, saved.ctm)), []
        self.run(self.doc.decoded(x)[0], x.dict.get("Resources", resources), depth + 1)
        self.state, self.stack, (self.tm, self.tlm) = saved, stack, text

    def _move(self, x: float, y: float) -> None:
        self.tm = self.tlm = then((1.0, 0.0, 0.0, 1.0, x, y), self.tlm)

    def _show(self, data: bytes) -> None:
        s = self.state
        if s.font is None:
            return
        codes = s.font.decode(data)
        if len(codes) > 1 and not s.font.vertical and type(self).on_glyph is Interpreter.on_glyph and all(map(math.isfinite, (*self.tm, *s.ctm))):
            codes = self._show_along(codes)
        for code in codes:
            self._show_one(*code)

    def _show_one(self, code: int, n: int, text: str, width: float) -> None:
        s = self.state
        placed = then((s.size * s.stretch, 0.0, 0.0, s.size, 0.0, s.rise), then(self.tm, s.ctm))
        space = s.word if n == 1 and code == 32 else 0.0
        if s.font.vertical:
            move = (1.0, 0.0, 0.0, 1.0, 0.0, -s.size + s.char + space)
        else:
            move = (1.0, 0.0, 0.0, 1.0, (width * s.size + s.char + space) * s.stretch, 0.0)
        length = math.hypot(placed[0], placed[1]) * width if not s.font.vertical else math.hypot(placed[2], placed[3])
        self.on_glyph(Glyph(code, text, placed, length, math.hypot(placed[2], placed[3]), s.font.vertical, s.font.name, bool(self.scopes and self.scopes[-1]), s.mode))
        self.tm = then(move, self.tm)


    def _show_along(self, codes: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        """All but the first glyph of a string, whose shape they share: only their places are worked out. What is left to show: none."""
        s, left = self.state, codes[1:]
        self._show_one(*codes[0])
        c0, c1, c2, c3, c4, c5 = s.ctm
        t0, t1, t2, t3, x, y = self.tm
        n0, n1, n2, n3, _, _ = then(self.tm, s.ctm)
        p0, p1, p2, p3, _, _ = then((s.size * s.stretch, 0.0, 0.0, s.size, 0.0, s.rise), (n0, n1, n2, n3, 0.0, 0.0))
        up, over, right, high = 0.0 * n0 + s.rise * n2, 0.0 * n1 + s.rise * n3, 0.0 * t2, 0.0 * t3
        across, size, name, artifact, mode, stretch, char, word = math.hypot(p0, p1), math.hypot(p2, p3), s.font.name, bool(self.scopes and self.scopes[-1]), s.mode, s.stretch, s.char, s.word
        add, scale = self.glyphs.append, s.size
        for code, n, text, width in left:
            add(Glyph(code, text, (p0, p1, p2, p3, up + (x * c0 + y * c2 + c4), over + (x * c1 + y * c3 + c5)), across * width, size, False, name, artifact, mode))
            move = (width * scale + char + (word if n == 1 and code == 32 else 0.0)) * stretch
            x, y = move * t0 + right + x, move * t1 + high + y
        self.tm = (t0, t1, t2, t3, x, y)
        return []


def _matrix(a: list) -> Matrix:
    return tuple(float(x) for x in a[-6:]) if len(a) >= 6 else IDENTITY


@dataclass
class Line:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    size: float
    vertical: bool
    block: int


def lines(glyphs: list[Glyph]) -> list[Line]:
    """Glyphs in the order shown, as lines; artifacts are left out.

    A line ends where the direction turns, where a glyph leaves the baseline, goes back by over half its size, or skips more than
    three; a gap of a fifth is a space. A block ends where the next line is over one and a half sizes away.
    """
    out: list[Line] = []
    run: list[Glyph] = []
    pen = (0.0, 0.0)
    shape, ux, uy, turned = None, 1.0, 0.0, False

    def flush() -> None:
        text = "".join(g.text for g in run)
        if text.strip():
            xs: list[float] = []
            ys: list[float] = []
            shape = level = None
            for g in run:
                a, b, c, d, e, f = g.matrix
                if (a, b) != shape:
                    shape, k = (a, b), math.hypot(a, b) or 1.0
                    ux, uy = a / k, b / k
                x, y = ux * g.advance, uy * g.advance
                xs += (e + 0.0, e + 0.0 + c, e + x, e + x + c)
                if (f, y, d) != level:  # most glyphs stand as high as the one before
                    level = f, y, d
                    ys += (f + 0.0, f + 0.0 + d, f + y, f + y + d)
            box = Line(text, min(xs), min(ys), max(xs), max(ys), run[0].size, run[0].vertical, 0)
            if out:
                box.block = out[-1].block + (abs(out[-1].y0 - box.y0) > 1.5 * box.size)
            out.append(box)
        run.clear()

    for g in glyphs:
        if g.artifact:
            continue
        a, b, c, d, e, f = g.matrix
        if not (math.isfinite(e) and math.isfinite(f)):
            continue
        if (a, b, c, d) != shape:  # glyphs of a string have one shape
            if not all(map(math.isfinite, (a, b, c, d))):
                continue
            shape, k = (a, b, c, d), math.hypot(a, b) or 1.0
            ux, uy = a / k, b / k
            if run:
                last = run[-1].matrix
                kk = math.hypot(last[0], last[1]) or 1.0
                turned = abs(ux * last[1] / kk - uy * last[0] / kk) > 0.01
        if run:
            dx, dy = e - pen[0], f - pen[1]
            along, across = dx * ux + dy * uy, dy * ux - dx * uy
            if turned or abs(across) > 0.5 * g.size or along < -0.5 * g.size or along > 3 * g.size:
                flush()
            elif along > 0.2 * g.size and not run[-1].text.endswith(" ") and not g.text.startswith(" "):
                run.append(replace(g, text=" ", advance=0.0))
        run.append(g)
        turned = False
        pen = (e + ux * g.advance, f + uy * g.advance) if not g.vertical else (e, f - g.advance)
    flush()
    return out
