"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD_PATTERN, cut, scratch, unused

#: Documents of one length are dealt to so many buckets by their seeded hash, so that no single length is one task.
BUCKETS = 256


def targets(totals: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; a target stops at `most` times
    its source's size, and the excess is shared again by weight until none is above. That is the level L with
    sum(min(most * size, L * weight)) = share * sum(size), found with one window over the sources: with the sources sorted by
    their ratio of top to weight, the greatest level that the first uncapped one allows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = totals.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("w"))
    rows = rows.withColumn("top", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)  # frames that only grow cost one pass
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("top"), level)).over(everything))
    # Where every source is at its top (share >= most) there is no level.
    return rows.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("top")), F.col("top")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, hold: int = 4096) -> np.ndarray:
    """How many documents of each length (distinct, positive) to take, so that the words come as near `budget` as can be.

    A proportional share of each length is taken first, then long documents, both while over `hold` words remain. A bounded-knapsack
    dynamic programme fills what remains from the documents left over: a set of reachable sums, in the bits of one integer,
    for each power-of-two part of a length's count.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    order = np.argsort(-lengths, kind="stable")
    size, spare = lengths[order].tolist(), counts[order].tolist()
    take = [c * max(0, budget - hold) // total for c in spare]
    left = budget - sum(s * t for s, t in zip(size, take, strict=True))
    for i, s in enumerate(size):
        if (more := min(spare[i] - take[i], max(0, left - hold) // s)) > 0:
            take[i] += more
            left -= more * s
    limit = left + max(hold, min(s for s, c, t in zip(size, spare, take, strict=True) if c > t))
    parts: list[tuple[int, int]] = []
    for i, s in enumerate(size):
        free, k = min(spare[i] - take[i], limit // s), 1
        while free > 0:
            parts.append((i, min(k, free)))
            free -= k
            k *= 2
    reach, within = [1], (1 << (limit + 1)) - 1
    for i, k in parts:
        reach.append((reach[-1] | reach[-1] << (k * size[i])) & within)
        if reach[-1] >> left & 1:
            break
    at = (reach[-1] & ((1 << (left + 1)) - 1)).bit_length() - 1
    if over := reach[-1] >> left:
        above = left + (over & -over).bit_length() - 1
        at = above if above - left < left - at else at
    for n in range(len(reach) - 2, -1, -1):
        if not reach[n] >> at & 1:
            i, k = parts[n]
            take[i] += k
            at -= k * size[i]
    out = np.empty_like(counts)
    out[order] = take
    return out


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's counts by length, of which there are no more than lengths."""
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    take = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), round(target - target // size * size))
    return rows[["source_id", "size"]].assign(take=take)


def _row_hash(id_col: str, source_col: str, text_col: str, seed: int) -> Column:
    """A seeded hash of what tells rows apart; a null hashes unlike anything else."""
    parts = [x for c in (id_col, source_col, text_col) for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.xxhash64(F.lit(seed), *parts)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """(id_col, row_hash, source_col, size, source_size, target, times): a row for each row of docs; the mix takes it `times` times.

    size counts the words of the text (null: 0). Documents are counted by exact length; each source takes its whole passes,
    and then as many documents of each length as fit() says, of equal lengths those with the least seeded hash of id, source
    and text.
    What one task gathers of a source are its counts by length. Documents of no words go with the whole passes, and once where
    their source has no words at all. Rows that repeat are rows of their own; null ids and sources are kept; an empty table
    gives an empty result; other columns of docs are ignored. The result reads three tables in the shared folder: drop_cut()
    deletes them.
    """
    with scratch(docs.sparkSession) as keep:
        text = F.col(text_col).cast("string")
        source_id = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
        rows = cut(
            docs.select(
                F.col(id_col).alias("id"),
                F.col(source_col).cast("string").alias("source"),
                F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
                _row_hash(id_col, source_col, text_col, seed).alias("row_hash"),
            ).withColumns({"source_id": source_id, "bucket": F.pmod(F.xxhash64("row_hash"), F.lit(BUCKETS)).cast("int")}),
            "sizes",
        )
        counts = cut(rows.groupBy("source_id", "size", "bucket").agg(F.first("source").alias("source"), F.count("*").alias("n")), "lengths")
        totals = counts.groupBy("source_id").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
        aims = targets(totals.select("source", "source_size"), weights, share, most).withColumn("source_id", source_id).drop("source")
        aims = cut(aims.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")), "targets")
        by_length = counts.where("size > 0").groupBy("source_id", "size").agg(F.sum("n").alias("n")).join(aims, "source_id")
        takes = by_length.groupBy("source_id").applyInPandas(_fit_source, "source_id long, size long, take long")
        # A length's documents are taken bucket by bucket: all of the first ones, a part of one, none of the rest.
        before = F.sum("n").over(Window.partitionBy("source_id", "size").orderBy("bucket")) - F.col("n")
        quotas = counts.drop("source").join(takes.hint("merge"), ["source_id", "size"]).withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - before)))
        quotas = cut(quotas.where("quota > 0").select("source_id", "size", "bucket", "n", "quota"), "quotas")
        # By merge joins: these tables grow with the documents, and are far smaller as files than in memory.
        keyed = rows.join(quotas.hint("merge"), ["source_id", "size", "bucket"], "left")
        in_part = F.coalesce(F.col("quota") < F.col("n"), F.lit(False))
        place = F.row_number().over(Window.partitionBy("source_id", "size", "bucket").orderBy("row_hash", "id"))
        some = keyed.where(in_part).withColumn("one", (place <= F.col("quota")).cast("long"))
        rest = keyed.where(~in_part).withColumn("one", F.col("quota").isNotNull().cast("long"))
        taken = some.unionByName(rest).join(aims, "source_id")
        return keep(taken.select(F.col("id").alias(id_col), "row_hash", F.col("source").alias(source_col), "size", "source_size", "target", (F.col("full") + F.col("one")).alias("times")), rows, quotas, aims)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The rows of docs, with all their columns, as often as mix() takes them.

    Rows with one id, source and text share what is taken of them, the first by all columns (those with maps in them aside) first.
    Null ids, sources and texts are values like others; an empty table gives an empty result; no column name of docs clashes.
    """
    names = docs.columns
    own_id, own_hash, times_, n, key, own, copy = unused(docs, "id", "hash", "times", "n", "key", "own", "copy")
    # Maps have no order, wherever in a column they are.
    ordered = [x for x, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    with scratch(docs.sparkSession) as keep:
        times = mix(docs, id_col, source_col, text_col, weights, share, most, seed).select(F.col(id_col).alias(own_id), F.col("row_hash").alias(own_hash), F.col("times").alias(times_))
        # Rows that are equal but for other columns share what the mix takes of them.
        times = cut(times.groupBy(own_id, own_hash).agg(F.sum(times_).alias(times_), F.count("*").alias(n)).where(F.col(times_) > 0), "times")
        keyed = docs.withColumn(key, _row_hash(id_col, source_col, text_col, seed))
        joined = keyed.join(times.hint("merge"), (F.col(key) == F.col(own_hash)) & F.col(id_col).eqNullSafe(F.col(own_id)))
        single = joined.where(F.col(n) == 1).withColumn(own, F.col(times_))
        place = F.row_number().over(Window.partitionBy(own_hash, own_id).orderBy(*ordered))
        many = joined.where(F.col(n) > 1).withColumn(own, F.floor(F.col(times_) / F.col(n)) + (place <= F.col(times_) % F.col(n)).cast("long"))
        rows = single.unionByName(many).where(F.col(own) > 0)
        return keep(rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own).cast("int")))).select(*names), times)
