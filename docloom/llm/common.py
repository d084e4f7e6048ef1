"""What the operators of this subpackage share: tables, the shared folder, cutting lineage, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.checkpoints import shared_dir

#: The characters that end a word, as a class of regular expressions and as bytes (what bytes.split() splits at).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"

#: Far more than the logarithm of any number of nodes.
_STAR_ROUNDS = 60

#: The tables that cut() wrote in each open scratch().
_open: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, read by Spark alone: the folder may be in a store that only Spark reaches."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/docloom-{what}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so a lost executor costs no more than a read.

    The path stands in the attribute `cut_path` of the result.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Deletes at its end what cut() wrote inside.

    It gives keep(result, *tables): the result, whose tables stay for as long as it is read; drop_cut(result) deletes them, and
    an outer scratch() does so too.
    """
    mine: list[str] = []
    kept: list[str] = []

    def keep(result: DataFrame, *tables: DataFrame) -> DataFrame:
        kept[:] = [t.cut_path for t in tables]
        result.cut_paths = kept
        return result

    _open.append(mine)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _open.remove(mine)
        for path in mine:
            if path not in kept:
                delete_path(spark, path)
        if _open:
            _open[-1].extend(kept)


def release(spark: SparkSession) -> str | None:
    """Gives the system back what the driver holds and no longer uses; what the JVM says of it, or None where it can't trim.

    Planning many queries leaves garbage that lets the heap grow, and freed native memory that the C library keeps for each of
    the driver's hundreds of threads. No table or result is touched.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    gateway = spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return server.invoke(name, "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0))
    except Py4JError:
        return None


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made = f"__{name}"
        while made.lower() in taken:
            made += "_"
        out.append(made)
    return out


def join_once(rows: DataFrame, once: DataFrame, key: str, many: DataFrame, salts: int = 256) -> DataFrame:
    """rows joined, left, with the row that `once` has for their key (a key has one at most).

    `many` holds keys (a column named like `key`) that a large share of rows may have: those rows are dealt out over `salts`
    numbers and their rows of `once` repeated for each. It is broadcast, so its maker bounds it: see `crowded_keys`.
    """
    flags = F.broadcast(many.select(key).withColumn("__many", F.lit(True)))
    names = [c for c in once.columns if c != key]
    dealt = rows.join(flags, key, "left").withColumn("__salt", F.when(F.col("__many"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != key]), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__many")
    copies = F.when(F.col("__many"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = once.join(flags, key, "left").withColumn("__salt", F.explode(copies)).drop("__many")
    return dealt.join(repeated, [key, "__salt"], "left").select(*rows.columns, *names)


def crowded_keys(counts: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """The keys that over 1 in `share` of all `total` rows have: fewer than `share` of them. counts holds (key, n), each key once."""
    return counts.where(F.col(n) > max(1000, total // share)).select(key)


def drop_cut(df: DataFrame | None) -> None:
    """Deletes what cut() wrote, and what scratch() kept for a result."""
    if df is not None:
        for path in [*getattr(df, "cut_paths", []), *([df.cut_path] if getattr(df, "cut_path", None) else [])]:
            delete_path(df.sparkSession, path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links, as rows (node, root); root is the smallest node of the component.

    Large-star and small-star rounds: each is a partial aggregate and a join on the links, whose number never grows, and ends
    in a table in the shared folder. Nothing is collected but one sum a round. Nodes without links aren't returned; links of
    a node to itself and repeated links do no harm; null ends are left out.
    """
    spark = links.sparkSession
    low, high = F.least(a, b), F.greatest(a, b)
    edges = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v")).distinct(), "links")
    mark = None
    for _ in range(_STAR_ROUNDS):
        # Large star: each node passes the least of its neighbours and itself on to its larger neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node links its smaller neighbours and itself to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(edges)
        edges = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components didn't settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    out.cut_path = edges.cut_path
    return out
