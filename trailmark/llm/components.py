"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round replaces a node's edges by edges to the smallest neighbour - found by an aggregation, which combines on
the map side, and joined back - until every component is a star. Each round's edges are written to the shared
folder. Only a count and a checksum of the edges come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import written


def _star(edges: DataFrame) -> DataFrame:
    """edges a, b: for each b of a, (b, smallest of a and its b's)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select("a", "b", F.least("a", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge. edges: a, b longs, in either direction,
    repeats and loops allowed. An error, if the edges have not settled after `rounds`."""
    one = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    one = written(one.distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = one.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _star(large)
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        one = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return one.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(
        one.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
