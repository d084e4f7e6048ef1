"""Groupings of ordered rows: islands, newest rows, folds of lines and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """rows with the number, from 0, of the run that each is in: a run ends before a row whose `breaks` holds.

    `breaks` is written with before(), the value of the row before; the first row of each `by` never breaks.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = rows.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def before(col: str, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(col).over(Window.partitionBy(*by).orderBy(*order))


def text_lines(glyphs: DataFrame, page: Sequence[str] = ("doc_id", "page_index"), turn: float = 0.01, far: float = 0.5) -> DataFrame:
    """glyphs (page, seq, x, y, angle, size, pen_x, text) with `line`: a new one where the text turns, leaves the baseline or goes back.

    x, y is where a glyph starts and pen_x where the one before left the pen. Only a lag over the page, so a page is never one row.
    """
    p = lambda c: before(c, page, ["seq"])
    breaks = (F.abs(F.col("angle") - p("angle")) > turn) | (F.abs(F.col("y") - p("y")) > far * F.greatest("size", p("size"))) | (F.col("x") < p("x") - far * F.col("size"))
    return islands(glyphs, page, ["seq"], breaks, "line")


def text_blocks(lines: DataFrame, page: Sequence[str] = ("doc_id", "page_index"), gap: float = 1.5) -> DataFrame:
    """lines (page, line, y, size) with `block`: a new one where the step to the line before is over `gap` times the line's size."""
    return islands(lines, page, ["line"], F.abs(before("y", page, ["line"]) - F.col("y")) > gap * F.col("size"), "block")


def collapse_margins(rows: DataFrame, by: Sequence[str], margin: str) -> DataFrame:
    """(by, margin): of adjoining margins, the greatest positive plus the least negative."""
    return rows.groupBy(*by).agg((F.greatest(F.max(margin), F.lit(0.0)) + F.least(F.min(margin), F.lit(0.0))).alias(margin))


def pen_positions(rows: DataFrame, by: Sequence[str], order: str, advance: str) -> DataFrame:
    """rows with `pen`: the sum of the advances before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pen", F.coalesce(F.sum(advance).over(w), F.lit(0.0)))


def pack(widths: Column, available: Column) -> Column:
    """ARRAY<INT>: the line of each item, filled greedily; an item wider than a line has one of its own."""
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("used"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["line"] >= 0) & (acc["used"] + w <= available)
        line = F.when(fits, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(line.alias("line"), F.when(fits, acc["used"] + w).otherwise(w).alias("used"), F.concat(acc["out"], F.array(line)).alias("out"))

    return F.aggregate(widths, start, step, lambda acc: acc["out"])


def paginate(text: Column, columns: int, lines: int) -> Column:
    """ARRAY<STRUCT<page, line, text>> of fixed-pitch pages: paragraphs at line feeds, words packed greedily into `columns`.

    Words longer than a line stand alone, a blank paragraph is a blank line, and no character but white space at a line's ends
    is lost. One pass of a regular expression over a paragraph takes as much of it as fits, line by line.
    """
    longest = f"(?s)(?:([^ ]{{{columns + 1},}})|(.{{1,{columns}}}))(?: |\\z)"

    def paragraph(p: Column) -> Column:
        words = F.trim(F.regexp_replace(p, r"[ \t\r\f]+", " "))
        filled = F.regexp_replace(words, longest, "$1$2\n")
        return F.when(words == "", F.array(F.lit(""))).otherwise(F.split(F.left(filled, F.length(filled) - 1), "\n", -1))

    rows = F.flatten(F.transform(F.split(text, "\n", -1), paragraph))
    return F.transform(rows, lambda r, i: F.struct(F.floor(i / lines).cast("int").alias("page"), (i % lines).cast("int").alias("line"), r.alias("text")))
