"""Connected components of a table of links, by alternating large and small stars.

Every step is a shuffle of links; hubs are joined with a written table of
minima, so that adaptive execution can split a hub's rows over tasks. Each
round is written to the scratch folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import Scratch

MAX_ROUNDS = 60


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links (u, v) with u > v."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that is nobody's larger one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
    return bad.isEmpty()


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.put(both.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__v")).select("__u", F.least("__u", "__v").alias("__m")), "least")
    return both.where("v > u").join(least, F.col("u") == F.col("__u")).select(F.col("v").alias("u"), F.col("__m").alias("v"))


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.put(links.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m")), "least")
    joined = links.join(least, F.col("u") == F.col("__u")).select("v", "__m")
    return joined.select(F.col("v").alias("u"), F.col("__m").alias("v")).where("u <> v").unionByName(least.select(F.col("__u").alias("u"), F.col("__m").alias("v")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every linked node that is not its component's smallest node, which is the root."""
    now = scratch.put(_oriented(links), "links")
    for _ in range(MAX_ROUNDS):
        if _is_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        big = scratch.put(_large_star(now, scratch), "large")  # repeated links may stay until the small star
        now = scratch.put(_oriented(_small_star(big, scratch)), "small")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
