"""URL filters as a sort-merge range join, with DataFrame operations only.

A host becomes its labels in reverse, each followed by a dot ("www.a.org": "org.a.www."), so that a host and its subdomains
are the interval [key, key with "/" for the last dot). Rule intervals nest or are apart. A sorted sweep over their ends keeps
the stack of active rules: the depth is a running sum, and what the stack has at each depth is the rules last opened there. That
gives a list of points with the stack from there on. Points and urls are then dealt out by ranges of the key and sorted, and
each url takes the last point before it; of the stack's rules, the longest whose path the url's path starts with wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, scratch

#: (host, path, verdict)
Rule = tuple[str, str, str]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first :// up to / ? # or the end, A-Z lower-cased, and from there up to ? # or the end.

    Both are empty for a null url and one without "://".
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_points(rules: DataFrame) -> DataFrame:
    """(key, stack) from (host, path, verdict): the rules that are active from each key on, longest first.

    A rule given twice for one host and path counts as the one with the least verdict; one with a null or empty host never
    fits. The windows run over one top-level label at a time, since nothing nests across those.
    """
    rules = rules.where("host != '' and path is not null").select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    one = F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"), "host", "path", "verdict")
    hosts = rules.withColumn("key", host_key(F.col("host"))).groupBy("key").agg(F.collect_list(one).alias("own"))
    close = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    opened = hosts.select(F.col("key").alias("at"), F.lit(1).alias("step"), "own")
    closed = hosts.select(close.alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(hosts.schema["own"].dataType).alias("own"))
    ends = opened.union(closed).withColumn("top", F.split("at", r"[./]")[0])
    ends = ends.withColumn("depth", F.sum("step").over(Window.partitionBy("top").orderBy("at")))
    # The stack after an end: at each depth up to the present one, the rules last opened there.
    levels = ends.select("top", "at", F.explode_outer(F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth").cast("int")))).alias("level"), F.col("depth"), "own")
    pushed = F.when(F.col("level") == F.col("depth"), F.col("own"))
    levels = levels.withColumn("active", F.last(pushed, True).over(Window.partitionBy("top", "level").orderBy("at")))
    return levels.groupBy(F.col("at").alias("key")).agg(F.sort_array(F.flatten(F.collect_list("active")), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame | Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict): a row for each row of pages.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest (host and path together,
    then host) wins; without any, rule is null and the verdict is `default`. Null urls and urls without "://" have an empty
    host and path. Rows that repeat are kept; other columns of pages are ignored; without pages or rules nothing fails. Equal
    urls are dealt out by a hash of their ids, so that no host, nor any one url, is one task.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([*rules], "host string, path string, verdict string")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    points = rule_points(rules)
    stack = dict(points.dtypes)["stack"]
    both = urls.select(host_key(F.col("host")).alias("key"), F.xxhash64("id").alias("salt"), F.lit(False).alias("is_point"), "id", "host", "path", F.lit(None).cast(stack).alias("stack")).union(
        # Before all urls of the same key.
        points.select("key", F.lit(-(2**63)).alias("salt"), F.lit(True), F.lit(None).cast(dict(urls.dtypes)["id"]), F.lit(None).cast("string"), F.lit(None).cast("string"), "stack")
    )
    with scratch(spark) as keep:
        dealt = cut(both.repartitionByRange(parts, "key", "salt").withColumn("part", F.spark_partition_id()), "urls")
        ends = dealt.where("is_point").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
        every = dealt.select("part").distinct().join(ends, "part", "left")
        # As many rows as there are partitions: what the sweep brings along from the ranges before.
        brought = every.select("part", F.last("stack", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("brought"))
        swept = dealt.withColumn("active", F.last("stack", True).over(Window.partitionBy("part").orderBy("key", F.col("is_point").desc(), "salt").rowsBetween(Window.unboundedPreceding, 0)))
        found = swept.where("not is_point").join(brought, "part", "left").withColumn("active", F.coalesce("active", "brought"))
        best = F.try_element_at(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
        found = found.withColumn("best", best)
        return keep(found.select(F.col("id").alias(id_col), "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")), dealt)
