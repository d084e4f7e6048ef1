"""Lookups: as-of and range joins, overlays, multiset intersection, nearest match. All of them are plans that Catalyst sees whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.checkpoints import checkpointed


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str) -> DataFrame:
    """left with `value` of the right row that has the greatest `on` not above left's, within `by`; null before the first.

    One union, one shuffle by `by` and a running last(): no pair of rows is ever made, so large sides and long ranges cost a
    sort. Without `by`, rows are dealt out by ranges of `on`. Of right rows that tie, the one with the greatest value counts.
    """
    cols = left.columns
    extra = [c for c in cols if c not in (*by, on)]
    a = left.select(*by, on, F.lit(1).alias("__side"), F.struct(*extra).alias("__row") if extra else F.lit(True).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    b = right.select(*by, on, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    order = Window.partitionBy(*by).orderBy(on, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    # A null value of a range must hide the range before, so the value travels in a struct.
    boxed = F.when(F.col("__side") == 0, F.struct(F.col("__value").alias("v")))
    if by:
        rows = a.unionByName(b).withColumn("__found", F.last(boxed, True).over(order)).where("__side = 1")
    else:
        rows = _swept(a.unionByName(b), on, boxed).where("__side = 1")
    return rows.select(*[F.col(c) if c in (*by, on) else F.col("__row")[c].alias(c) for c in cols], F.col("__found")["v"].alias(value))


def _swept(rows: DataFrame, on: str, boxed: Column) -> DataFrame:
    """rows with __found, the last boxed value at or before each, with no key to deal them out by.

    Ranges of `on` are partitions, each sorted by itself; what a partition brings along from those before it is one value, found
    from as many rows as there are partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.withColumn("__box", boxed).repartitionByRange(parts, on, "__side").withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(on, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("__part").agg(F.max_by("__box", F.when(F.col("__box").isNotNull(), F.struct(on, "__value"))).alias("__end"))
    brought = ends.select("__part", F.last("__end", True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    out = dealt.withColumn("__own", F.last("__box", True).over(within)).join(brought, "__part", "left")
    return out.withColumn("__found", F.coalesce("__own", "__before"))


def overlay(base: DataFrame, changes: DataFrame, key: str, deleted: str = "deleted") -> DataFrame:
    """base with rows replaced or added by changes, and those that changes marks as deleted left out."""
    cols = base.columns
    kept = base.join(changes.select(key), key, "left_anti").select(cols)
    return kept.unionByName(changes.where(~F.col(deleted)).select(cols))


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each `by` with the greatest `order`: an aggregate that combines before it shuffles."""
    rest = [c for c in rows.columns if c not in (*by, *order)]
    best = rows.groupBy(*by).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*by, *[F.col("__best")[c].alias(c) for c in (*order, *rest)])


def multiset_similarity(a: DataFrame, b: DataFrame, key: Sequence[str], word: str = "word") -> DataFrame:
    """(key, similarity): words that two sides share, with repeats, over the words of the larger; 1 if neither has any."""
    ca, cb = (x.groupBy(*key, word).agg(F.count("*").alias(n)) for x, n in ((a, "__a"), (b, "__b")))
    both = ca.join(cb, [*key, word], "full")
    sums = both.groupBy(*key).agg(F.sum(F.least(F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0)))).alias("__same"), F.coalesce(F.sum("__a"), F.lit(0)).alias("__na"), F.coalesce(F.sum("__b"), F.lit(0)).alias("__nb"))
    most = F.greatest("__na", "__nb")
    return sums.select(*key, F.when(most == 0, 1.0).otherwise(F.col("__same") / most).alias("similarity"))


def range_lookup(rows: DataFrame, code: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi", value: str = "value") -> DataFrame:
    """rows with the value of the range [lo, hi] that holds `code`; ranges don't overlap; null outside of all.

    The range that starts last before the code is the only one that can hold it, so this is asof() and a test of its end.
    """
    starts = ranges.select(F.col(lo).alias(code), F.struct(F.col(hi).alias("hi"), F.col(value).alias("v")).alias("__range"))
    found = asof(rows, starts, [], code, "__range")
    return found.withColumn(value, F.when(F.col("__range.hi") >= F.col(code), F.col("__range.v"))).select(*rows.columns, value)


def intervals_hit(points: DataFrame, areas: DataFrame, by: Sequence[str], x0: str, x1: str) -> DataFrame:
    """points whose span [x0, x1) overlaps an area's [a0, a1) of the same `by`: a0 < x1 and x0 < a1.

    Areas are swept with the points in order of their starts: a span overlaps one if it starts before the greatest end so far,
    or ends after the next start. Nothing is paired. An empty span is hit inside an area only, not where that starts. A null in
    `by` equals nothing.
    """
    cols = points.columns
    known = lambda df: df.dropna(subset=[*by]) if by else df
    # An empty span comes before the areas that start where it stands.
    side = F.when(F.col(x0) == F.col(x1), -1).otherwise(1)
    a = known(points).select(*by, F.col(x0).alias("__x"), side.alias("__side"), F.lit(None).cast("double").alias("__end"), F.struct(*cols).alias("__row"))
    b = known(areas).select(*by, F.col("a0").cast(points.schema[x0].dataType).alias("__x"), F.lit(0).alias("__side"), F.col("a1").cast("double").alias("__end"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    order = Window.partitionBy(*by).orderBy("__x", "__side")
    # The next start, as the last one of the rows in reverse: frames that only grow cost one pass.
    back = Window.partitionBy(*by).orderBy(F.col("__x").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    swept = a.unionByName(b).withColumns({"__reach": F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.last(F.when(F.col("__side") == 0, F.col("__x")), True).over(back)})
    hit = (F.col("__reach") > F.col("__x")) | (F.col("__next") < F.col("__row")[x1])
    return swept.where((F.col("__side") != 0) & hit).select("__row.*")


def only_in(rows: DataFrame, others: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """rows whose key others don't have: an anti join, which never pairs rows."""
    keys = [key] if isinstance(key, str) else [*key]
    return rows.join(others.select(*keys), keys, "left_anti")


def prioritised(rows: DataFrame, tables: Sequence[tuple[DataFrame, str]], value: str) -> DataFrame:
    """rows with `value` from the first of the tables (each with its key, which rows have too) that has a value for them; null from none.

    A table has a key once at most; each is an equality join, whose way Spark chooses by size.
    """
    out, found = rows, []
    for i, (df, key) in enumerate(tables):
        found.append(f"__value{i}")
        out = out.join(df.select(key, F.col(value).alias(found[-1])), key, "left")
    return out.select(*rows.columns, F.coalesce(*found).alias(value))


def nearest(requests: DataFrame, faces: DataFrame, match: Column, distance: Column, key: str, value: str) -> DataFrame:
    """(key, value) of the face with the least distance among those that match; faces are few and their size is Spark's to check."""
    return requests.join(faces, match).groupBy(key).agg(F.min_by(value, distance).alias(value))
