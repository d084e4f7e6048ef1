"""Layout of boxes onto pages: widths, lines, floats of free space, and pages that keep paragraphs together.

Boxes of a document are laid out in one go by a task; what comes out are rows of positioned runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.breaking import opportunities


@dataclass(frozen=True)
class Options:
    width: float = 432.0
    height: float = 648.0
    margin: float = 36.0
    size: float = 10.0
    pitch: float = 0.6
    leading: float = 1.2
    orphans: int = 2
    widows: int = 2

    @property
    def columns(self) -> float:
        return self.width - 2 * self.margin

    @property
    def rows(self) -> float:
        return self.height - 2 * self.margin


@dataclass(frozen=True)
class Box:
    """A block of text; breaks are auto, always or avoid."""

    text: str
    size: float = 1.0
    indent: float = 0.0
    marker: str = ""
    before: float = 0.0
    after: float = 0.0
    page_before: str = "auto"
    inside: str = "auto"
    white_space: str = "normal"


Metrics = Callable[[str, float], float]


def fixed_pitch(pitch: float) -> Metrics:
    return lambda text, size: len(text) * size * pitch


def break_lines(text: str, available: float, size: float, metrics: Metrics, white_space: str = "normal") -> list[str]:
    """Lines packed greedily; a word wider than a line is cut where it overflows."""
    if white_space in ("normal", "nowrap"):
        text = " ".join(text.split(None)) if text.strip() else ""
    if white_space in ("nowrap", "pre"):
        return text.split("\n") if white_space == "pre" else [text] if text else []
    out, start, fit = [], 0, 0
    for place, mandatory in opportunities(text):
        while metrics(text[start:place].rstrip(" \n"), size) > available:
            if fit > start:
                out.append(text[start:fit].rstrip(" \n"))
                start = fit
                continue
            end = start + 1
            while end < place and metrics(text[start : end + 1], size) <= available:
                end += 1
            if end >= place:
                break
            out.append(text[start:end])
            start = fit = end
        fit = place
        if mandatory and (start < place or place < len(text)):
            out.append(text[start:place].rstrip(" \n"))
            start = place
    return out


def paginate(boxes: Sequence[Box], o: Options) -> list[dict[str, Any]]:
    """Runs (page, ord, x, y, width, text, size, generated): y is a line's top, counted down from the page's.

    Margins of neighbours collapse to the greatest positive plus the least negative; margins at a page's top vanish. A box starts
    a page if it must, or if it avoids a break and fits on one; else at least `orphans` lines stay and `widows` lines go on,
    where the box has so many.
    """
    metrics, runs, page, y, gap = fixed_pitch(o.pitch), [], 0, 0.0, 0.0
    for box in boxes:
        size = o.size * box.size
        height = size * o.leading
        lines = break_lines(box.text, o.columns - box.indent, size, metrics, box.white_space)
        if not lines:
            gap = max(gap, box.before, box.after, 0.0) + min(gap, box.before, box.after, 0.0)
            continue
        space = max(gap, box.before, 0.0) + min(gap, box.before, 0.0)
        gap = box.after
        if y > 0 and (box.page_before == "always" or (box.inside == "avoid" and y + space + height * len(lines) > o.rows and height * len(lines) <= o.rows)):
            page, y = page + 1, 0.0
        y += space if y > 0 else 0.0
        done = 0
        while done < len(lines):
            room = int((o.rows - y + 1e-9) // height)
            rest = len(lines) - done
            take = min(rest, room)
            if take < rest:
                if rest - take < o.widows:
                    take = rest - o.widows
                if take < o.orphans and (done or take < rest) and y > 0:
                    take = 0
                if y == 0 and take < min(o.orphans, room):  # a page's top has no better place to go to
                    take = min(rest, max(1, room))
            if take <= 0:
                page, y = page + 1, 0.0
                continue
            for k in range(done, done + take):
                if box.marker and k == 0:
                    w = metrics(box.marker, size)
                    runs.append(_run(page, runs, o.margin + box.indent - w - size * o.pitch, o.margin + y, w, box.marker, size, True))
                runs.append(_run(page, runs, o.margin + box.indent, o.margin + y, metrics(lines[k], size), lines[k], size, False))
                y += height
            done += take
            if done < len(lines):
                page, y = page + 1, 0.0
    return runs


def _run(page: int, runs: list, x: float, y: float, width: float, text: str, size: float, generated: bool) -> dict[str, Any]:
    return {"page": page, "ord": len(runs), "x": round(x, 6), "y": round(y, 6), "width": round(width, 6), "text": text, "font_size": size, "generated": generated}


_SCHEMA = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("ord", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("width", pa.float64()), ("text", pa.string()), ("font_size", pa.float64()), ("generated", pa.bool_())])


def lay_out(docs: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, page, ord, x, y, width, text, font_size, generated) of documents whose lines are paragraphs."""
    o = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of many documents leave together, 2000 or those of one document.
        held: list[dict[str, Any]] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = paginate([Box(p, before=o.size / 2, after=o.size / 2) for p in (text.as_py() or "").split("\n")], o)
                for row in rows:
                    row["id"] = doc_id
                held += rows
                if len(held) >= 2000:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, page int, ord long, x double, y double, width double, text string, font_size double, generated boolean").withColumnRenamed("id", id_col)


# Tables.


def column_constraints(columns: int, cells: Sequence[tuple[int, int, float, float]], declared: Sequence[float | None] = ()) -> list[tuple[float, float]]:
    """(least, greatest) width of each column from cells (column, span, least, greatest); a wide cell's excess is shared."""
    out = [(0.0, 0.0)] * columns
    for at, span, low, high in sorted(cells, key=lambda c: c[1]):
        part = out[at : at + span]
        if span == 1 and part:
            out[at] = (max(part[0][0], low), max(part[0][1], high))
        elif part:
            for k, want in ((0, low), (1, high)):
                have = sum(p[k] for p in part)
                if want > have:
                    for i in range(len(part)):
                        share = (want - have) * (part[i][1] / sum(p[1] for p in part) if sum(p[1] for p in part) else 1 / len(part))
                        out[at + i] = (out[at + i][0] + share, out[at + i][1]) if k == 0 else (out[at + i][0], out[at + i][1] + share)
    return [(max(lo, d), max(lo, d)) if d is not None else (lo, max(lo, hi)) for (lo, hi), d in zip(out, [*declared, *[None] * columns], strict=False)]


def distribute(constraints: Sequence[tuple[float, float]], width: float) -> list[float]:
    """Column widths: the least, plus what is left by how much each could grow; beyond the greatest, by their widths."""
    low, high = sum(c[0] for c in constraints), sum(c[1] for c in constraints)
    if width <= low:
        return [c[0] for c in constraints]
    if width <= high:
        return [a + (b - a) * (width - low) / (high - low) for a, b in constraints]
    return [b + (width - high) * (b / high if high else 1 / len(constraints)) for _, b in constraints]


def automatic_width(constraints: Sequence[tuple[float, float]], available: float, caption: float = 0.0) -> float:
    low, high = sum(c[0] for c in constraints), sum(c[1] for c in constraints)
    return max(caption, low, min(high, available))


def whole_table(children: Sequence[tuple[str, object]]) -> list[list[list[object]]]:
    """Rows of cells of a table's children (display, box): what is no row or cell is put in ones without an element.

    Rows are lists of cells, cells lists of boxes; a row's box is its list of (display, box). Cells in a run, and other boxes in
    a run, share one row; boxes that follow each other share one cell.
    """
    rows: list[list[list[object]]] = []
    loose = False  # whether the last row stands for no element
    joined = False  # whether its last cell does
    for display, box in children:
        if display == "table-row":
            rows.append(whole_row(box))
            loose = False
            continue
        if not loose:
            rows.append([])
            loose, joined = True, False
        if display == "table-cell":
            rows[-1].append([box])
            joined = False
        elif joined:
            rows[-1][-1].append(box)
        else:
            rows[-1].append([box])
            joined = True
    return rows


def whole_row(children: Sequence[tuple[str, object]]) -> list[list[object]]:
    """Cells of a row's children: boxes in a run that are none share one."""
    cells: list[list[object]] = []
    joined = False
    for display, box in children:
        if joined and display != "table-cell":
            cells[-1].append(box)
        else:
            cells.append([box])
        joined = display != "table-cell"
    return cells


def place_cells(rows: Sequence[Sequence[tuple[int, int]]]) -> list[list[int]]:
    """Column of each cell (column span, row span), past the cells that reach down from above."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows):
        at, placed = 0, []
        for across, down in row:
            while any((r, at + k) in taken for k in range(max(1, across))):
                at += 1
            placed.append(at)
            taken |= {(r + i, at + k) for i in range(max(1, min(down, len(rows) - r))) for k in range(max(1, across))}
        out.append(placed)
    return out


def collapse_borders(edges: Sequence[tuple[float, str, int]]) -> tuple[float, str, int] | None:
    """The border that wins of (width, style, source rank): hidden, then the widest, then the style, then the least rank."""
    styles = ("none", "inset", "groove", "outset", "ridge", "dotted", "dashed", "solid", "double")
    if any(e[1] == "hidden" for e in edges):
        return None
    real = [e for e in edges if e[1] != "none"]
    return max(real, key=lambda e: (e[0], styles.index(e[1]) if e[1] in styles else 0, -e[2]), default=None)


# Flexible boxes.


def flex(items: Sequence[tuple[float, float, float, float, float]], available: float) -> list[float]:
    """Sizes of items (basis, grow, shrink, least, greatest): free space is shared, and what breaks a bound freezes at it."""
    clamp = lambda v, i: min(max(v, i[3]), i[4])
    growing = sum(clamp(i[0], i) for i in items) < available
    factor = [i[1] if growing else i[2] * i[0] for i in items]
    sizes = [clamp(i[0], i) for i in items]
    frozen = [f == 0 or (growing and i[0] > s) or (not growing and i[0] < s) for f, i, s in zip(factor, items, sizes, strict=True)]
    first = available - sum(s if z else i[0] for s, z, i in zip(sizes, frozen, items, strict=True))
    while not all(frozen):
        free = available - sum(s if z else i[0] for s, z, i in zip(sizes, frozen, items, strict=True))
        live = [k for k, z in enumerate(frozen) if not z]
        total = sum(items[k][1] if growing else items[k][2] for k in live)
        if total < 1:
            free = free if abs(free) < abs(first * total) else first * total
        weight = sum(factor[k] for k in live)
        over = 0.0
        for k in live:
            want = items[k][0] + (free * factor[k] / weight if weight else 0)
            sizes[k] = clamp(want, items[k])
            over += sizes[k] - want
        for k in live:
            want = items[k][0] + (free * factor[k] / weight if weight else 0)
            if over == 0 or (over > 0 and sizes[k] > want) or (over < 0 and sizes[k] < want):
                frozen[k] = True
    return sizes


def flex_lines(widths: Sequence[float], available: float, wrap: bool = True) -> list[tuple[int, int]]:
    """(first, end) of each line's items."""
    out, start, used = [], 0, 0.0
    for i, w in enumerate(widths):
        if wrap and i > start and used + w > available:
            out.append((start, i))
            start, used = i, 0.0
        used += w
    return [*out, (start, len(widths))] if widths else []


def justify(kind: str, free: float, count: int) -> tuple[float, float]:
    """(offset, gap between items)."""
    free = max(0.0, free) if kind.startswith("space") else free
    if kind in ("flex-end", "end", "right"):
        return free, 0.0
    if kind == "center":
        return free / 2, 0.0
    if kind == "space-between" and count > 1:
        return 0.0, free / (count - 1)
    if kind == "space-around" and count:
        return free / count / 2, free / count
    if kind == "space-evenly" and count:
        return free / (count + 1), free / (count + 1)
    return 0.0, 0.0


# Floats.


@dataclass
class Floats:
    """Boxes at the left and right edge: each goes as high as it can, no higher than the one before it."""

    width: float
    placed: list[tuple[str, float, float, float, float]]  # side, x, y, width, height

    def edges(self, y: float, height: float) -> tuple[float, float]:
        left, right = 0.0, self.width
        for side, x, top, w, h in self.placed:
            if top < y + height and y < top + h:
                left, right = (max(left, x + w), right) if side == "left" else (left, min(right, x))
        return left, right

    def place(self, side: str, width: float, height: float, hint: float) -> tuple[float, float]:
        y = max([hint, *[p[2] for p in self.placed]])
        steps = sorted({y, *[p[2] + p[4] for p in self.placed if p[2] + p[4] > y]})
        for at in steps:
            left, right = self.edges(at, max(height, 1e-9))
            if right - left >= width or at == steps[-1]:
                x = left if side == "left" else right - width
                self.placed.append((side, x, at, width, height))
                return x, at
        raise AssertionError

    def clear(self, side: str, y: float) -> float:
        return max([y, *[p[2] + p[4] for p in self.placed if side in (p[0], "both")]])
