"""Closures over edges, and trees by paths."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.checkpoints import checkpointed


def reachable(edges: DataFrame, start: DataFrame, avoid: DataFrame | None = None, src: str = "src", dst: str = "dst", rounds: int | None = None) -> DataFrame:
    """(node): all nodes that `start` (a column node) reaches, itself included, without entering nodes of `avoid`.

    Each round joins the newest nodes with the edges and drops what was seen; its result is checkpointed, so neither the plan nor
    what a lost executor costs grows with the rounds. Cycles end by themselves. More than `rounds` rounds, where given, raise an error.
    """
    kept = edges.select(F.col(src).alias("node"), F.col(dst).alias("__next"))
    if avoid is not None:
        kept = kept.join(avoid.select(F.col("node").alias("__next")), "__next", "left_anti")
        start = start.join(avoid.select("node"), "node", "left_anti")
    seen = frontier = checkpointed(start.select("node").distinct())
    parts = 1
    for done in itertools.count():
        frontier = checkpointed(frontier.join(kept, "node").select(F.col("__next").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        if done == rounds:
            raise RuntimeError(f"nodes are left after {rounds} rounds")
        # A round writes what is new; what was seen is those tables together, made one before they are too many for a plan.
        seen, parts = seen.union(frontier), parts + 1
        if parts == 32:
            seen, parts = checkpointed(seen), 1


def follow(links: DataFrame, start: DataFrame, most: int = 32) -> DataFrame:
    """(node, end, hops): where chains of links (node, target) end after `most` hops at most; a chain in a circle ends there."""
    now = checkpointed(start.select("node", F.col("node").alias("end"), F.lit(0).alias("hops")))
    steps = links.select(F.col("node").alias("end"), F.col("target"))
    for _ in range(most):
        moved = F.col("target").isNotNull()
        after = checkpointed(now.join(steps, "end", "left").select("node", F.coalesce("target", "end").alias("end"), (F.col("hops") + moved.cast("int")).alias("hops"), moved.alias("__moved")))
        now = after.select("node", "end", "hops")
        if after.where("__moved").isEmpty():
            break
    return now


def inherit(tree: DataFrame, attributes: Sequence[str], levels: int | None = None) -> DataFrame:
    """(node, depth, path, *attributes) of a tree (node, parent, seq, *attributes): null attributes come from the nearest ancestor.

    Nodes that no root reaches (circles) aren't returned. path orders the tree depth first. A round takes one join per level; more
    than `levels` levels, where given, raise an error.
    """
    rows = tree.select("node", "parent", "seq", *attributes)
    level = checkpointed(rows.where("parent is null").select("node", F.lit(0).alias("depth"), F.array("seq").alias("path"), *attributes))
    out = level
    for depth in itertools.count(1):
        above = level.select(F.col("node").alias("parent"), "depth", "path", *[F.col(a).alias(f"__{a}") for a in attributes])
        level = checkpointed(rows.join(above, "parent").select("node", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("seq")).alias("path"), *[F.coalesce(a, f"__{a}").alias(a) for a in attributes]))
        if level.isEmpty():
            return out
        if depth == levels:
            raise RuntimeError(f"nodes are left below {levels} levels")
        out = out.union(level)
