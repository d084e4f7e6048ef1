"""Colours, blend modes and functions of colour, as arithmetic on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The D50 white point, XYZ (D50) to linear sRGB.
WHITE = (0.964_212, 1.0, 0.825_188)
TO_RGB = ((3.134_136, -1.617_036, -0.490_662), (-0.978_755, 1.916_143, 0.033_454), (0.071_95, -0.228_988, 1.405_386))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def to_byte(value: Column) -> Column:
    """0..1 to 0..255, half away from zero; 0 where not finite."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.floor(clamp(value, 0.0, 1.0) * 255.0 + 0.5)).otherwise(0).cast("int")


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def gray_to_rgb(v: Column) -> Column:
    return _rgb(to_byte(v), to_byte(v), to_byte(v))


def rgb(r: Column, g: Column, b: Column) -> Column:
    return _rgb(to_byte(r), to_byte(g), to_byte(b))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    light = 1.0 - clamp(k, 0.0, 1.0)
    return _rgb(*[to_byte((1.0 - clamp(x, 0.0, 1.0)) * light) for x in (c, m, y)])


def components_to_rgb(components: Column) -> Column:
    """By their number: 1 gray, 4 CMYK, else RGB; what is missing is 0."""
    at = lambda i: F.coalesce(F.try_element_at(components, F.lit(i)), F.lit(0.0))
    n = F.size(components)
    return F.when(n == 1, gray_to_rgb(at(1))).when(n == 4, cmyk_to_rgb(at(1), at(2), at(3), at(4))).otherwise(rgb(at(1), at(2), at(3)))


def srgb_transfer(linear: Column) -> Column:
    v = clamp(linear, 0.0, 1.0)
    return F.when(v <= 0.003_130_8, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def lab_to_rgb(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    fy = (l + 16.0) / 116.0

    def back(t: Column) -> Column:
        return F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) * (3 * (6 / 29) ** 2))

    xyz = [back(t) * w for t, w in zip((fy + a / 500.0, fy, fy - b / 200.0), WHITE, strict=True)]
    return _rgb(*[to_byte(srgb_transfer(xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2])) for row in TO_RGB])


def indexed(index: Column, lookup: Column, high: int, components: int) -> Column:
    """The bytes of a palette's entry as 0..1; index is rounded and clamped, missing bytes are 0."""
    at = clamp(F.round(index), 0, high).cast("int") * components
    return F.transform(F.sequence(F.lit(1), F.lit(components)), lambda i: F.coalesce(F.try_element_at(lookup, at + i), F.lit(0)) / 255.0)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma, rounded, with weights of a thousand."""
    return F.least(F.lit(255), F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000)).cast("int")


def _mul(a: Column, b: Column) -> Column:
    """a * b / 255, rounded."""
    return F.floor((a * b + 127) / 255).cast("int")


def blend(mode: str, cb: Column, cs: Column) -> Column:
    """One channel of a separable blend mode; backdrop and source are 0..255."""
    cb, cs = F.least(cb, F.lit(255)).cast("int"), F.least(cs, F.lit(255)).cast("int")
    white = F.lit(255)
    match mode:
        case "Multiply":
            return _mul(cb, cs)
        case "Screen":
            return cb + cs - _mul(cb, cs)
        case "Overlay":
            return blend("HardLight", cs, cb)
        case "Darken":
            return F.least(cb, cs)
        case "Lighten":
            return F.greatest(cb, cs)
        case "ColorDodge":
            return F.when(cb == 0, 0).when(cs >= 255, 255).otherwise(F.least(white, F.floor(cb * 255 / F.nullif(white - cs, F.lit(0))).cast("int")))
        case "ColorBurn":
            return F.when(cb >= 255, 255).when(cs == 0, 0).otherwise(white - F.least(white, F.floor((white - cb) * 255 / F.nullif(cs, F.lit(0))).cast("int")))
        case "HardLight":
            s = cs * 2 - 255
            return F.when(cs <= 127, _mul(cb, cs * 2)).otherwise(cb + s - _mul(cb, s))
        case "SoftLight":
            low = _mul(_mul(F.greatest(F.lit(0), cb * 16 - 12 * 255), cb) + 4 * 255, cb)
            d = F.when(cb <= 63, low).otherwise(F.floor(F.sqrt(cb * 255))).cast("int")
            s = cs * 2 - 255
            return F.when(cs <= 127, F.greatest(F.lit(0), cb - _mul(_mul(-s, cb), white - cb))).otherwise(cb + _mul(s, F.greatest(F.lit(0), d - cb)))
        case "Difference":
            return F.abs(cb - cs)
        case "Exclusion":
            return cb + cs - _mul(cb, cs) * 2
    return cs


SEPARABLE = ("Normal", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion")


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """The linear map of [x0, x1] to [y0, y1]; an empty domain gives y0."""
    return F.lit(y0) if x0 == x1 else (x - x0) * ((y1 - y0) / (x1 - x0)) + y0


def exponential(x: Column, c0: Sequence[float], c1: Sequence[float], n: float, domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """c0 + x**n * (c1 - c0), x clamped to the domain."""
    p = F.pow(clamp(x, *domain), F.lit(n))
    return F.array(*[p * (b - a) + a for a, b in zip(c0, c1, strict=True)])


def stitching(x: Column, domain: tuple[float, float], bounds: Sequence[float], encode: Sequence[tuple[float, float]], functions: Sequence) -> Column:
    """Subdomains [d0, b1), [b1, b2), ...: each maps x to its own function's domain."""
    x, edges, out = clamp(x, *domain), [domain[0], *bounds, domain[1]], None
    for i, f in enumerate(functions):
        value = f(interpolate(x, edges[i], edges[i + 1], *encode[i]))
        last = i == len(functions) - 1
        out = (F.when(x < edges[i + 1], value) if out is None else out.when(x < edges[i + 1], value)) if not last else (value if out is None else out.otherwise(value))
    return out


def parse_colour(text: Column) -> Column:
    """#RRGGBB and #AARRGGBB, one digit a channel or two, as STRUCT<a, r, g, b> in 0..255; null for anything else.

    sc# takes three or four reals, alpha first: colours in linear light, which the curve of sRGB turns into bytes.
    """
    t = F.upper(F.trim(text))
    twice = F.regexp_replace(t, "([0-9A-F])", "$1$1")
    digits = F.when(t.rlike("^#[0-9A-F]{3,4}$"), F.substring(twice, 2, 8)).when(t.rlike("^#(?:[0-9A-F]{6}|[0-9A-F]{8})$"), F.substring(t, 2, 8))
    full = F.lpad(digits, 8, "F")
    at = lambda k: F.conv(F.substring(full, k, 2), 16, 10).cast("int")
    reals = F.transform(F.split(F.substring(t, 4, 1 << 20), ","), lambda x: F.trim(x).try_cast("double"))
    linear = (t.startswith("SC#")) & F.size(reals).isin(3, 4) & F.forall(reals, lambda x: x.isNotNull() & ~F.isnan(x))
    light = lambda k: to_byte(srgb_transfer(clamp(F.element_at(reals, k), 0, 1)))
    alpha = F.when(F.size(reals) == 4, to_byte(clamp(F.element_at(reals, 1), 0, 1))).otherwise(255)
    made = lambda a, r, g, b: F.struct(a.cast("int").alias("a"), r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))
    return F.when(full.isNotNull(), made(at(1), at(3), at(5), at(7))).when(linear, made(alpha, light(-3), light(-2), light(-1)))


# Blend modes over all channels. A colour is an array of three bytes.


def _lum(c: Column) -> Column:
    return F.floor((c[0] * 77 + c[1] * 150 + c[2] * 29) / 256).cast("int")


def _clip(c: Column) -> Column:
    """Pulled towards its luma until every channel is a byte."""
    light, low, high = _lum(c), F.array_min(c), F.array_max(c)
    up = F.transform(c, lambda v: F.when(low < 0, light + F.floor((v - light) * light / F.nullif(light - low, F.lit(0)))).otherwise(v))
    down = F.transform(up, lambda v: F.when(high > 255, light + F.floor((v - light) * (255 - light) / F.nullif(high - light, F.lit(0)))).otherwise(v))
    return F.transform(down, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.coalesce(v, light))).cast("int"))


def _set_lum(c: Column, light: Column) -> Column:
    d = light - _lum(c)
    return _clip(F.transform(c, lambda v: v + d))


def _set_sat(c: Column, s: Column) -> Column:
    low, high = F.array_min(c), F.array_max(c)
    return F.transform(c, lambda v: F.coalesce(F.floor((v - low) * s / F.nullif(high - low, F.lit(0))), F.lit(0)).cast("int"))


def _sat(c: Column) -> Column:
    return F.array_max(c) - F.array_min(c)


def blend_nonseparable(mode: str, cb: Column, cs: Column) -> Column:
    """Hue, Saturation, Color and Luminosity; any other mode gives the source."""
    match mode:
        case "Hue":
            return _set_lum(_set_sat(cs, _sat(cb)), _lum(cb))
        case "Saturation":
            return _set_lum(_set_sat(cb, _sat(cs)), _lum(cb))
        case "Color":
            return _set_lum(cs, _lum(cb))
        case "Luminosity":
            return _set_lum(cb, _lum(cs))
    return cs
