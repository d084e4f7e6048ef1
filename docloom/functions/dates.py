"""Dates: the lenient D: form of documents and the forms that people type."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Output patterns by index; any other index is 1.
PATTERNS = ("M/D", "M/D/YY", "M/D/YYYY", "MM/DD/YY", "MM/DD/YYYY", "D-Mon", "D-Mon-YY", "D-Mon-YYYY", "DD-Mon-YY", "DD-Mon-YYYY", "YY-MM-DD", "YYYY-MM-DD")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: what stands in an expression twice is otherwise worked out twice."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_pdf_date(text: Column) -> Column:
    """STRUCT of a date "D:YYYYMMDDHHmmSSOHH'mm'": null without a year; what is missing has its default, what is out of range is clamped."""
    return _let(F.regexp_replace(F.trim(text), "^D:", ""), _pdf_date)


def _pdf_date(s: Column) -> Column:
    def number(at: int, n: int) -> Column:
        part = F.substring(s, at + 1, n)
        return F.when(part.rlike(f"^[0-9]{{{n}}}$"), part.cast("int"))

    def field(at: int, default: int, low: int, high: int) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(number(at, 2), F.lit(default))))

    sign = F.substring(s, 15, 1)
    minutes = F.greatest(F.lit(0), F.least(F.lit(59), F.coalesce(number(18, 2), number(17, 2), F.lit(0))))
    offset = field(15, 0, 0, 23) * 60 + minutes
    return F.when(
        number(0, 4).isNotNull(),
        F.struct(
            number(0, 4).alias("year"),
            field(4, 1, 1, 12).alias("month"),
            field(6, 1, 1, 31).alias("day"),
            field(8, 0, 0, 23).alias("hour"),
            field(10, 0, 0, 59).alias("minute"),
            F.least(F.lit(59), field(12, 0, 0, 60)).alias("second"),
            F.when(sign == "+", offset).when(sign == "-", -offset).when(sign == "Z", 0).alias("offset_minutes"),
        ),
    )


def expand_year(year: Column, digits: Column) -> Column:
    """Two digits below 50 are of this century, others of the last."""
    return F.when(digits > 2, year).when(year < 50, year + 2000).otherwise(year + 1900)


def parse_date(text: Column) -> Column:
    """STRUCT<year, month, day> of three parts split at - / . space or comma: Y-M-D if four digits lead, else M-D-Y, or with a month's name."""
    return _let(F.filter(F.split(F.trim(text), r"[-/. ,]+"), lambda p: p != ""), _typed_date)


def _typed_date(parts: Column) -> Column:
    part = lambda k: F.try_element_at(parts, F.lit(k))
    num = lambda k: F.when(part(k).rlike("^[0-9]{1,9}$"), part(k).cast("int"))
    names = F.array(*[F.lit(m.lower()) for m in MONTHS])
    month = lambda k: F.nullif(F.array_position(names, F.lower(F.left(part(k), F.lit(3)))).cast("int"), F.lit(0))
    year = lambda k: expand_year(num(k), F.length(part(k)))

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.when(y.between(1, 9999) & m.between(1, 12) & d.between(1, 31), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))

    return F.when(
        F.size(parts) == 3,
        F.when(num(1).isNotNull() & num(2).isNotNull() & num(3).isNotNull(), F.when(F.length(part(1)) == 4, made(num(1), num(2), num(3))).otherwise(made(year(3), num(1), num(2))))
        .when(num(1).isNotNull() & num(3).isNotNull(), made(year(3), month(2), num(1)))
        .when(num(2).isNotNull() & num(3).isNotNull(), made(year(3), month(1), num(2))),
    )


def format_date(date: Column, index: int) -> Column:
    """A parsed date by a pattern's index."""
    pattern = PATTERNS[index] if 0 <= index < len(PATTERNS) else PATTERNS[1]
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year, month, day = date["year"], date["month"], date["day"]
    pieces = {
        "YYYY": F.lpad(year.cast("string"), 4, "0"),
        "YY": two(F.pmod(year, F.lit(100))),
        "Mon": F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month),
        "MM": two(month),
        "M": month.cast("string"),
        "DD": two(day),
        "D": day.cast("string"),
    }
    mark = "/" if "/" in pattern else "-"
    return F.concat_ws(mark, *[pieces[p] for p in pattern.split(mark)])


def format_date_text(text: Column, index: int) -> Column:
    """What isn't a date is left as it is."""
    return _let(parse_date(text), lambda date: F.when(date.isNotNull(), format_date(date, index)).otherwise(text))


def format_date_texts(text: Column, indexes: Sequence[int]) -> Column:
    """STRUCT<f0, ...> of one text in several patterns, which is read once for all of them."""
    made = lambda date: F.struct(*[F.when(date.isNotNull(), format_date(date, i)).otherwise(text).alias(f"f{i}") for i in indexes])
    return _let(parse_date(text), made)
