"""Changes to documents as changes to tables: every function returns a new DataFrame, and nothing changes in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumbered(pages: DataFrame, order: Column, by: str = "doc_id", index: str = "page_index") -> DataFrame:
    """Pages numbered from 0 in the order of a column."""
    return pages.withColumn(index, (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("int"))


def move_page(pages: DataFrame, at: int, to: int, by: str = "doc_id", index: str = "page_index") -> DataFrame:
    """Page `at` taken out and put in as page `to`; documents without such pages stay as they are."""
    i = F.col(index)
    n = F.count("*").over(Window.partitionBy(by))
    there = (n > at) & (n > to) & F.lit(at >= 0 and to >= 0)
    # Between two pages there is room for a half.
    goal = F.when(i == at, F.lit(to + (0.5 if to > at else -0.5))).otherwise(i.cast("double"))
    return renumbered(pages.withColumn("__goal", F.when(there, goal).otherwise(i.cast("double"))), F.col("__goal"), by, index).drop("__goal")


def delete_pages(pages: DataFrame, gone: DataFrame, by: str = "doc_id", index: str = "page_index") -> DataFrame:
    """Without the pages of (by, index), the rest renumbered."""
    return renumbered(pages.join(gone.select(by, index), [by, index], "left_anti").select(pages.columns), F.col(index), by, index)


def keep_pages(pages: DataFrame, kept: DataFrame, by: str = "doc_id", index: str = "page_index") -> DataFrame:
    """Only the pages of (by, index), renumbered."""
    return renumbered(pages.join(kept.select(by, index).distinct(), [by, index], "left_semi").select(pages.columns), F.col(index), by, index)


def insert_page(pages: DataFrame, at: int, width: float, height: float, by: str = "doc_id", index: str = "page_index") -> DataFrame:
    """A blank page before page `at`, or as the last one; other columns of it are null, its boxes are (0, 0, width, height)."""
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(width)).alias("x1"), F.lit(float(height)).alias("y1"))
    made = {by: F.col(by), index: F.lit(at), "media_box": box, "crop_box": box, "rotation": F.lit(0)}
    blank = pages.select(by).distinct().select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in pages.schema])
    both = pages.withColumn("__new", F.lit(1)).unionByName(blank.withColumn("__new", F.lit(0)))
    return renumbered(both, F.struct(index, "__new"), by, index).drop("__new")


def rotate_pages(pages: DataFrame, degrees: Column, rotation: str = "rotation") -> DataFrame:
    """Degrees added to the rotation, to quarter turns."""
    from docloom.functions.geometry import normalize_rotation

    return pages.withColumn(rotation, normalize_rotation(F.col(rotation) + degrees))


# Fields: (doc_id, name, kind, value, many, default, flags, options, max_len).

READ_ONLY = 1


def accepts(value: Column) -> Column:
    """Whether a field may take a value: not if it is read-only, too long, or no option of a choice that isn't editable."""
    free = (F.col("flags").bitwiseAND(F.lit(READ_ONLY)) == 0) & ~F.col("kind").isin("pushbutton", "signature", "unknown")
    fits = F.col("max_len").isNull() | (F.length(value) <= F.col("max_len"))
    editable = (F.col("kind") == "combo") & (F.col("flags").bitwiseAND(F.lit(1 << 18)) != 0)
    listed = ~F.col("kind").isin("combo", "list") | editable | (F.size("options") == 0) | F.array_contains("options", value)
    return free & fits & listed & value.isNotNull()


def fill_fields(fields: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, refusals) of values (doc_id, name, new): a document whose every value is accepted changes, others don't at all.

    refusals names the first value of a document that its form refuses, by name.
    """
    keys = ["doc_id", "name"]
    wanted = values.select(*keys, "new").join(fields.withColumn("__known", F.lit(True)), keys, "left")
    judged = wanted.select(*keys, F.when(F.col("__known").isNull(), "no such field").when(~accepts(F.col("new")), "not accepted").alias("why"))
    refusals = judged.where("why is not null").groupBy("doc_id").agg(F.min(F.struct("name", "why")).alias("first")).select("doc_id", "first.name", "first.why")
    taken = values.select(*keys, "new").join(refusals.select("doc_id"), "doc_id", "left_anti")
    out = fields.join(taken.withColumn("__take", F.lit(True)), keys, "left")
    return out.select(*[F.when(F.col("__take"), F.col("new")).otherwise(F.col("value")).alias(c) if c == "value" else F.col(c) for c in fields.columns]), refusals


def select_radio(fields: DataFrame, name: str, option: str) -> DataFrame:
    """One button of a group on, the others off: buttons are fields whose name is the group's, a dot and more, or the group's."""
    group = (F.col("kind") == "radio") & ((F.col("name") == name) | F.startswith(F.col("name"), F.lit(name + ".")))
    chosen = F.col("name").isin(name + "." + option) | ((F.col("name") == name) & F.array_contains("options", option))
    return fields.withColumn("value", F.when(group, F.when(chosen, F.lit(option)).otherwise("Off")).otherwise(F.col("value")))


def set_checkbox(fields: DataFrame, name: str, on: bool) -> DataFrame:
    return fields.withColumn("value", F.when((F.col("kind") == "checkbox") & (F.col("name") == name), "Yes" if on else "Off").otherwise(F.col("value")))


def reset_form(fields: DataFrame) -> DataFrame:
    """Every value back to its default; buttons without one are off, read-only fields reset too."""
    blank = F.when(F.col("kind").isin("checkbox", "radio"), "Off")
    return fields.withColumn("value", F.when(F.col("kind") == "pushbutton", F.col("value")).otherwise(F.coalesce("default", blank)))


def calculation_order(fields: DataFrame) -> DataFrame:
    """Fields with `turn`: those in the calculation order first, by it, then the rest in document order."""
    order = Window.partitionBy("doc_id").orderBy(F.col("calculated").asc_nulls_last(), "seq")
    return fields.withColumn("turn", F.row_number().over(order))
