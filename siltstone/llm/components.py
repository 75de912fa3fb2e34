"""Connected components of a distributed edge list: alternating large-star and small-star steps.

Each step takes the least neighbour of every node by partial aggregation and joins it back; both sides of a join are written tables, so
adaptive execution splits the rows of a hub. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialise

ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge and the least node that it reaches. Self-loops, repeated edges and null ends are ignored.

    Without edges the result is empty. Raises if ROUNDS do not suffice (they do for 2**ROUNDS nodes in a row).
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("_ok"))
    edges = materialise(edges.filter("_ok and a > b").select("a", "b").distinct())
    before = _state(edges)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialise(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
        lowest = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        lower = large.join(lowest, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(lower.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
