"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

#: Rounds grow with the logarithm of the longest path; this many serve any graph that fits a cluster.
MAX_ROUNDS = 60


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), longs; component: the smallest node reachable.

    Loops, nulls and repeated edges are ignored. Only edges whose nodes differ give rows. Each round
    moves single edges between tasks: a hub's edges are folded to a minimum before the shuffle, and the
    join that hands the minimum back is one that Spark may split.
    """
    pairs = edges.filter("a is not null and b is not null and a <> b")
    star = common.cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _print(star)
    for _ in range(MAX_ROUNDS):
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large-star")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.cut(large, "large-edges")
        fewest = common.cut(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(fewest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, star = star, common.cut(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        common.release(before, least, large, fewest)
        now = _print(star)
        if now == seen:
            leaves = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return leaves.unionAll(roots)
        seen = now
    raise RuntimeError("components did not settle")
