"""Connected components of a graph that is too large for one machine.

Alternating large-star and small-star steps turn the edges into stars around the smallest node of each component, in a
number of rounds that grows with the logarithm of the graph. Each round's edges are a table in the shared folder, so
the lineage stays short and lost executors cost a task, not the job. The joins are between two such tables, which lets
adaptive execution split the partition of a node with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docslice.runtime import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large star: each node's larger neighbours go to its smallest one (or itself). Small
    star: its smaller neighbours and itself do."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = materialise(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    joined = near.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return materialise(out.filter(F.col("a") > F.col("b")).distinct(), "star-edges")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: two columns of node ids (long), in any direction, repeats and loops allowed. Returns node, component
    (the smallest node reachable) for all nodes of an edge but the smallest of each component."""
    a, b = edges.columns
    now = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") > F.col("b")).distinct(), "star-edges")
    mark = (0, None)
    for _ in range(rounds):
        now = _star(_star(now, True), False)
        # stars around the smallest nodes: no node is both a leaf and a centre, and no leaf has two centres
        n = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(n):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(n)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
