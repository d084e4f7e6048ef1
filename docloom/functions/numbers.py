"""Numbers as form fields write and read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thousands and decimal separators by style; any other style is 0.
SEPARATORS = {0: (",", "."), 1: ("", "."), 2: (".", ","), 3: ("", ",")}


def round_to(value: Column, decimals: int) -> Column:
    """Half away from zero on the value times a power of ten, in binary: 1.005 at 2 is 1.0."""
    scale = float(10**decimals)
    scaled = value * F.lit(scale)
    # floor(x + 0.5) is off where adding the half already rounds.
    whole = F.floor(F.abs(scaled))
    up = (F.abs(scaled) - whole >= 0.5).cast("double")
    return F.when(F.abs(scaled) >= 2.0**52, value).otherwise(F.signum(value) * (whole + up) / scale)


def text_number(text: Column) -> Column:
    """A tolerant reading: spaces, commas and currency signs are dropped; blank or unreadable is 0."""
    return F.coalesce(F.regexp_replace(text, "[ ,$£€¥]", "").try_cast("double"), F.lit(0.0))


def format_number(value: Column, decimals: int = 2, separators: int = 0, negative: int = 0, currency: str = "", prepend: bool = True) -> Column:
    """Grouped digits; the sign comes from the rounded value; negative styles 2 and 3 are parentheses. Null where not finite."""
    thousands, point = SEPARATORS.get(separators, SEPARATORS[0])
    rounded = round_to(value, decimals)
    plain = F.format_number(F.abs(rounded), decimals)
    body = F.translate(plain, ",.", "\x01\x02")
    body = F.replace(F.replace(body, F.lit("\x01"), F.lit(thousands)), F.lit("\x02"), F.lit(point))
    if currency:
        body = F.concat(F.lit(currency), body) if prepend else F.concat(body, F.lit(currency))
    minus = F.concat(F.lit("("), body, F.lit(")")) if negative in (2, 3) else F.concat(F.lit("-"), body)
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.when(rounded < 0, minus).otherwise(body))


def percent_format(value: Column, decimals: int = 2, separators: int = 0) -> Column:
    return F.concat(format_number(value * 100.0, decimals, separators), F.lit("%"))


def format_special(text: Column, style: int) -> Column:
    """Zip code (0), zip + 4 (1), phone (2) and social security (3) shapes; other lengths are left alone."""
    d = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(d)
    part = lambda a, k: F.substring(d, a, k)
    dash = F.lit("-")
    if style == 0:
        return F.when(n == 5, d).otherwise(text)
    if style == 1:
        return F.when(n == 9, F.concat(part(1, 5), dash, part(6, 4))).otherwise(text)
    if style == 2:
        return (
            F.when(n == 7, F.concat(part(1, 3), dash, part(4, 4)))
            .when(n == 10, F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), dash, part(7, 4)))
            .when((n == 11) & (part(1, 1) == "1"), F.concat(F.lit("1 ("), part(2, 3), F.lit(") "), part(5, 3), dash, part(8, 4)))
            .otherwise(text)
        )
    if style == 3:
        return F.when(n == 9, F.concat(part(1, 3), dash, part(4, 2), dash, part(6, 4))).otherwise(text)
    return text


def share_holds(passed_before: Column, total_before: Column, passed_now: Column, total_now: Column) -> Column:
    """Whether the share passed didn't fall, by cross-multiplication in decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    return wide(passed_now) * wide(total_before) >= wide(passed_before) * wide(total_now)
