"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.scratch import Scratch

MAX_ROUNDS = 60


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on its smallest neighbour."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        root = F.least("u", "m")
        return joined.filter("v > u").select(F.col("v").alias("u"), root.alias("v")).distinct()
    kept = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``u``, ``v`` (long) -> ``node``, ``root``: every node that is not the smallest of its component.

    Nodes without a row are their own component. Each round is written, so a lost executor costs one
    round; work is two joins on the edges per round, and rounds grow with the logarithm of the
    longest path. The smallest neighbour is combined before the shuffle.
    """
    turned = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    held = scratch.keep(turned.distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = scratch.keep(_stars(_stars(both, True), False), "edges")
        scratch.drop(held)
        held = step
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")
