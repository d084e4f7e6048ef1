"""The cascade: which declaration of a property counts for an element, and what it inherits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank by origin and importance, lowest first.
RANKS = (("ua", False, 1), ("user", False, 2), ("author", False, 3), ("author", True, 5), ("user", True, 6), ("ua", True, 7))


def rank(origin: Column, important: Column) -> Column:
    out = None
    for name, bang, value in RANKS:
        test = (origin == name) & (important == bang)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def specificity(selector: Column) -> Column:
    """STRUCT<a, b, c> of a simple or compound selector: ids, classes and attributes and pseudo-classes, types."""
    count = lambda pattern: F.regexp_count(selector, F.lit(pattern))
    return F.struct(count(r"#[\w-]+").alias("a"), count(r"\.[\w-]+|\[[^\]]*\]|(?<!:):[\w-]+").alias("b"), count(r"(?:^|[\s>+~])[a-zA-Z][\w-]*").alias("c"))


def matches(nodes: DataFrame, selectors: DataFrame, by: str = "page_id") -> DataFrame:
    """(by, node, sel) where a selector (sel, tag, id, class, parent_tag) fits; null parts fit anything.

    A parent's tag is an equality join of an element with the element that it stands in. Selectors meet their elements by their
    id, else a class, else the tag, else the parent's tag: what is paired are the elements that have it with the selectors
    that name it. A selector that names nothing fits every element.
    """
    parents = nodes.select(by, F.col("node").alias("parent"), F.col("tag").alias("__above"))
    rows = nodes.join(parents, [by, "parent"], "left")
    classes = F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+")
    key = lambda kind, value: F.struct(F.lit(kind).alias("k"), value.alias("v"))
    asked = F.when(F.col("sel_id").isNotNull(), key("id", F.col("sel_id"))).when(F.col("sel_class").isNotNull(), key("class", F.col("sel_class")))
    asked = asked.when(F.col("__tag").isNotNull(), key("tag", F.col("__tag"))).when(F.col("parent_tag").isNotNull(), key("above", F.col("parent_tag"))).otherwise(key("any", F.lit("")))
    has = F.concat(F.array(key("id", F.col("attrs")["id"]), key("tag", F.col("tag")), key("above", F.col("__above")), key("any", F.lit(""))), F.transform(F.array_distinct(classes), lambda c: key("class", c)))
    keyed = rows.select("*", F.explode(has).alias("__key")).where("__key.v is not null")
    out = keyed.join(selectors.withColumnRenamed("tag", "__tag").withColumn("__key", asked), "__key").where("__tag is null or __tag = tag")
    fits = (F.col("sel_id").isNull() | (F.col("attrs")["id"] == F.col("sel_id"))) & (F.col("sel_class").isNull() | F.array_contains(classes, F.col("sel_class"))) & (F.col("parent_tag").isNull() | (F.col("__above") == F.col("parent_tag")))
    return out.where(fits).select(by, "node", "sel")


def winners(matched: DataFrame, declarations: DataFrame, by: Sequence[str] = ("page_id", "node")) -> DataFrame:
    """(by, property, value): the declaration with the greatest rank, then specificity, then order; an aggregate with partial sums."""
    rows = matched.join(declarations, "sel")
    key = F.struct("rank", "a", "b", "c", "order")
    return rows.groupBy(*by, "property").agg(F.max_by("value", key).alias("value"))
