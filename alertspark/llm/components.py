"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is
    its least node.

    Large-star and small-star steps in turn until nothing changes: each hangs
    nodes on smaller neighbours, so the number of rounds grows with the
    logarithm of the longest path. Minima are combined before the shuffle; the
    join that spreads them is one that adaptive execution can split. Every
    round is a written table.
    """
    e = saved(edges.select("a", "b").where("a <> b").distinct(), "component-edges")
    mark = None
    while True:
        last = e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a hangs on a's least.
        large = saved(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .where("a <> b").distinct(), "component-large")
        # Small star: a and its smaller neighbours hang on the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        e = saved(moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "component-small")
        dropped(last, large)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
