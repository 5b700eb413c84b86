"""Connected components by alternating large and small stars; every round is two aggregations and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.stage import done, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Links to the smallest neighbour: large, of the larger neighbours; small, of the smaller ones and
    the node itself. The minimum is aggregated before the shuffle, and a node with very many edges is an ordinary
    skewed join."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        j = both.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = j.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v (integers) to node, component: the smallest node that it reaches. Nodes without edges are left out; loops
    and repeated edges change nothing."""
    # staged, as a round uses its edges several times and the links may be costly to find
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        before, e = e, staged(_star(_star(e, True), False), "stars")
        done(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
