"""Reports over runs of files: outcomes, capabilities, warnings, pass rates and the gate that they may not fall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.numbers import share_holds

# The outcomes of a file.
OUTCOMES = ("passed", "failed", "crashed", "timed_out")


def outcomes(files: DataFrame, by: Sequence[str] = ("corpus",), labels: Sequence[str] = OUTCOMES) -> DataFrame:
    """(by, outcome, files): a row for each label, counted or not."""
    every = files.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("outcome"))
    counts = files.groupBy(*by, "outcome").agg(F.count("*").alias("files"))
    return every.join(counts, [*by, "outcome"], "left").select(*by, "outcome", F.coalesce("files", F.lit(0)).alias("files"))


def files_per(files: DataFrame, items: str, name: str, by: Sequence[str] = ("corpus",)) -> DataFrame:
    """(by, name, files): files, not occurrences, per item of an array."""
    return files.select(*by, F.explode(F.array_distinct(items)).alias(name)).groupBy(*by, name).agg(F.count("*").alias("files"))


def summary(files: DataFrame, by: Sequence[str] = ("corpus",)) -> DataFrame:
    """(by, total, passed, degraded); by is null in the last row, of all corpora."""
    return files.rollup(*by).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "passed").alias("passed"), F.count_if(F.size("warnings") > 0).alias("degraded"))


def pivot(files: DataFrame, items: str, values: Sequence[str], by: str = "corpus") -> DataFrame:
    """A row per corpus, and one of all: files per capability."""
    per = files.select(by, F.explode(F.array_distinct(items)).alias("__item"))
    return per.rollup(by).agg(*[F.count_if(F.col("__item") == v).alias(v) for v in values])


def gate(before: DataFrame, now: DataFrame) -> DataFrame:
    """(corpus, verdict): missing, empty, fewer files, fell, new or holds; both sides are (corpus, total, passed)."""
    b = before.select("corpus", F.col("total").alias("tb"), F.col("passed").alias("pb"))
    n = now.select("corpus", F.col("total").alias("tn"), F.col("passed").alias("pn"))
    holds = share_holds(F.col("pb"), F.col("tb"), F.col("pn"), F.col("tn"))
    verdict = F.when(F.col("tb").isNull(), "new").when(F.col("tn").isNull(), "missing").when(F.col("tn") == 0, "empty").when(~holds, "fell").otherwise("holds")
    return b.join(n, "corpus", "full").select("corpus", verdict.alias("verdict"))


def merge_counts(maps: DataFrame, by: Sequence[str], counts: str) -> DataFrame:
    """(by, key, n) of partial counts in maps."""
    return maps.select(*by, F.explode(counts).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))


def capped(rows: DataFrame, by: Sequence[str], order: str, item: str, most: int) -> DataFrame:
    """(by, items, dropped): the first `most` items and how many more there are; only rows that stay are gathered."""
    from pyspark.sql import Window

    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.struct("__n", F.col(item).alias("v"))))).getField("v").alias("items"), F.count_if(F.col("__n") > most).alias("dropped"))
