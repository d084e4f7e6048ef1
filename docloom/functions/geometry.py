"""Rectangles, matrices and page geometry, as arithmetic on columns. A rectangle is STRUCT<x0, y0, x1, y1>, a matrix STRUCT<a .. f>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PIXELS = float(1 << 26)


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Two corners in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def rect_of(values: Column) -> Column:
    """Of an array of four numbers; null of fewer."""
    at = lambda i: F.element_at(values, i)
    return F.when(F.size(values) >= 4, rect(at(1), at(2), at(3), at(4)))


def intersect(a: Column, b: Column) -> Column:
    """Null where the rectangles share no area."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def normalize_rotation(degrees: Column) -> Column:
    """To a quarter turn, halves away from zero."""
    return (F.round(F.pmod(degrees, F.lit(360)) / 90) % 4 * 90).cast("int")


def display_size(box: Column, rotation: Column) -> Column:
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    turned = rotation.isin(90, 270)
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def page_scale(width: Column, height: Column, scale: Column) -> Column:
    """The scale, lowered so that the page has no more than MAX_PIXELS pixels."""
    area = width * height * scale * scale
    return F.when(area > MAX_PIXELS, F.sqrt(F.lit(MAX_PIXELS) / (width * height))).otherwise(scale)


def page_pixels(width: Column, height: Column, scale: Column) -> Column:
    """Rounded outward, one pixel at least; what arithmetic leaves over a whole number doesn't count."""
    out = lambda v: F.greatest(F.lit(1), F.ceil(v * scale - 1e-6)).cast("long")
    return F.struct(out(width).alias("width"), out(height).alias("height"))


def matrix(*v: Column) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for x, n in zip(v, "abcdef", strict=True)])


def then(m: Column, n: Column) -> Column:
    """First m, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"),
        (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"),
        (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((x * m["a"] + y * m["c"] + m["e"]).alias("x"), (x * m["b"] + y * m["d"] + m["f"]).alias("y"))


def invert(m: Column) -> Column:
    """Null for a matrix without an inverse."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    d = F.nullif(det, F.lit(0.0))
    return F.when(
        (det != 0) & ~F.isnan(det),
        F.struct(
            (m["d"] / d).alias("a"),
            (-m["b"] / d).alias("b"),
            (-m["c"] / d).alias("c"),
            (m["a"] / d).alias("d"),
            ((m["c"] * m["f"] - m["d"] * m["e"]) / d).alias("e"),
            ((m["b"] * m["e"] - m["a"] * m["f"]) / d).alias("f"),
        ),
    )


def path_bounds(xs: Column, ys: Column) -> Column:
    """Bounds of points in two arrays; points that aren't finite don't count; null without any."""
    ok = lambda v: F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.size(ok(xs)) > 0, F.struct(F.array_min(ok(xs)).alias("x0"), F.array_min(ok(ys)).alias("y0"), F.array_max(ok(xs)).alias("x1"), F.array_max(ok(ys)).alias("y1")))
